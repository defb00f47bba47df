"""Hashes of ranges of bytes, and arrays packed into binary columns, for work inside tasks."""

from __future__ import annotations

from functools import cache


@cache
def _constants():
    import numpy as np

    return np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64), 0x9E3779B97F4A7C15


_powers: list = []


def _power_tables(n: int):
    """Powers of the base and of its inverse, for ranges of texts up to n bytes; kept for the next text."""
    import numpy as np

    if not _powers or len(_powers[0]) <= n:
        base = _constants()[1]
        size = max(n + 1, 1 << 20)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, f, np.uint64)])) for f in (base, pow(base, -1, 1 << 64))]
    return _powers


class Hashes:
    """Polynomial hashes mod 2**64 of all ranges of a text, by prefix sums."""

    def __init__(self, text):
        import numpy as np

        self.power, back = (p[: len(text) + 1] for p in _power_tables(len(text)))
        self.sums = np.zeros(len(text) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_constants()[0][text] * back[:-1], out=self.sums[1:])

    def of(self, begin, end):
        import numpy as np

        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[begin]) * self.power[begin])

    def grams(self, k: int):
        import numpy as np

        with np.errstate(over="ignore"):
            return mixed((self.sums[k:] - self.sums[:-k]) * self.power[: len(self.sums) - k])


def mixed(h):
    import numpy as np

    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def narrow(a):
    """Non-negative ints in the least number of bytes that holds them."""
    import numpy as np

    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def pack(**arrays) -> bytes:
    import io

    import numpy as np

    out = io.BytesIO()
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        out.write(f"{name}:{a.dtype.str}:{len(raw)}\n".encode())
        out.write(raw)
    return out.getvalue()


def unpack(data: bytes) -> dict:
    import numpy as np

    out, at = {}, 0
    while at < len(data):
        end = data.index(b"\n", at)
        name, kind, size = data[at:end].decode().split(":")
        out[name] = np.frombuffer(data, kind, int(size) // np.dtype(kind).itemsize, end + 1)
        at = end + 1 + int(size)
    return out


def runs_of(values) -> list[tuple[int, int]]:
    """Where equal neighbours begin and end."""
    import numpy as np

    if not len(values):
        return []
    cuts = [*np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])).tolist(), len(values)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))
