"""Column functions. Every function takes columns and returns a column; none runs Python per row."""

from orfloom.functions.arrays import *  # noqa: F401,F403
from orfloom.functions.payload import *  # noqa: F401,F403
from orfloom.functions.sequences import *  # noqa: F401,F403
from orfloom.functions.text import *  # noqa: F401,F403
