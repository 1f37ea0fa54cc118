"""Training-data operators over the corpus tables.

One module per operator, each with a general DataFrame interface and one
thin registered query; ``registry`` gathers the queries and their SQL.
Nothing outside this folder imports it except the entry module's guard.
"""
