"""Column-expression building blocks (all JVM-side, codegen-friendly)."""
from .time import *  # noqa: F401,F403
from .congestion import *  # noqa: F401,F403
from .numeric import *  # noqa: F401,F403
