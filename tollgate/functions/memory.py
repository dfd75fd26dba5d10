"""Memory of Python tasks."""

import numpy as np

# Below 32 MB, the most that the C library takes as a threshold.
STEADY_BYTES = 24 << 20


def steady_heap() -> None:
    """Let the arrays of a loop get the same pages again and again. The C library asks the system for every array of some hundred KB and gives it
    back, which takes as long as the arithmetic; after a block of this size was freed once, it keeps smaller ones. The block is never touched."""
    np.empty(STEADY_BYTES, dtype=np.uint8)
