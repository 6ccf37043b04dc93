"""Arrow batches group by group, for rows that come in the order of their keys."""

from __future__ import annotations

from collections.abc import Iterator


def sorted_groups(batches: Iterator, keys: list[str]) -> Iterator[tuple[tuple, object]]:
    """(key, table) of runs of rows of one key; only the rows of the run at hand are held."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    held, now = [], None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for k in keys:
            column = batch.column(k)
            a, b = column.slice(0, n - 1), column.slice(1)
            same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy(zero_copy_only=False) & pc.is_null(b).to_numpy(zero_copy_only=False))
            new[1:] |= ~same
        starts = [0, *np.flatnonzero(new).tolist()]
        for at, end in zip(starts, [*starts[1:], n], strict=True):
            key = tuple(batch.column(k)[at].as_py() for k in keys)
            if held and key != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(at, end - at))
    if held:
        yield now, pa.Table.from_batches(held)


def matrix(column):
    """A column of lists of one length as a matrix of doubles."""
    import numpy as np
    import pyarrow as pa

    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(rows), -1) if len(rows) else flat.reshape(0, 0)
