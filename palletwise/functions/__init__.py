from palletwise.functions.columns import *  # noqa: F401,F403
from palletwise.functions.columns import __all__  # noqa: F401
