"""One numpy thread per task."""

from __future__ import annotations

import ctypes
import functools
from pathlib import Path

import numpy as np


@functools.cache
def one_thread() -> bool:
    """Let the matrix library bundled with numpy use one thread in this process, as Spark gives a task one core.

    More threads spin beside each other on the small matrices of a task. Returns whether the library was found; without
    it nothing changes.
    """
    found = False
    for path in sorted((Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*")):
        lib = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                found = True
                break
    return found
