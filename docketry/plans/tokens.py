"""Words of Arrow string columns and what is counted and hashed from them, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docketry.functions import hashing as H

LETTERS = np.zeros(256, bool)
LETTERS[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a string column without nulls."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return at - at[0], flat[at[0]:at[-1]]


def words(column: pa.Array, min_len: int = 3) -> tuple[np.ndarray, pa.Array]:
    """Row and text of every maximal run of at least ``min_len`` signs of a-z and 0-9, in order."""
    column = column.cast(pa.string())
    if not len(column):
        return np.empty(0, np.int64), pa.array([], pa.string())
    rows, flat = _bytes(column)
    inside = LETTERS[flat]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # A run ends with its row.
    edges = np.unique(rows[(rows > 0) & (rows < len(flat))])
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = end - start >= min_len
    start, size = start[long], (end - start)[long]
    ends = np.cumsum(size)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    picked = flat[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
    text = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(picked))
    return np.searchsorted(rows, start, "right") - 1, text


def fnv1a(tokens: pa.Array, seed: int) -> np.ndarray:
    """FNV-1a of ASCII tokens, all tokens of enough signs one sign at a time."""
    at, flat = _bytes(tokens)
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    start, longest = at[:-1][order], -size[order]
    out = np.full(len(order), seed, np.uint64)
    for k in range(-int(longest[0]) if len(order) else 0):
        n = np.searchsorted(longest, -k, "left")
        out[:n] = ((out[:n] ^ flat[start[:n] + k].astype(np.uint64)) * np.uint64(H.PRIME)) & np.uint64(H.MASK)
    back = np.empty_like(out)
    back[order] = out
    return back


def rolling31(texts: pa.Array) -> pa.Array:
    """``hashing.rolling31`` of whole texts, a text at a time."""
    longest = int(pc.max(pc.utf8_length(texts)).as_py() or 0)
    power = np.cumprod(np.concatenate([[1], np.full(longest, 31)]).astype(np.uint32), dtype=np.uint32)[:-1][::-1]
    out = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts.to_pylist()):
        signs = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
        out[i] = int((signs * power[longest - len(signs):]).sum(dtype=np.uint32))
    return pa.array(out)


def _lists(owner: np.ndarray, rows: int, values: pa.Array) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def features(titles: pa.Array, texts: pa.Array, stop: pa.Array, second_weight: float) -> pa.Array:
    """``tokens, counts, first, second, length, norm`` of lower-cased texts; the vector covers the title as well."""
    n = len(texts)
    title_row, title_words = words(titles)
    row, found = words(texts)
    coded = pa.concat_arrays([title_words, found]).dictionary_encode()
    vocabulary, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.concatenate([title_row, row])
    of_text = np.arange(len(code)) >= len(title_row)
    kept = ~pc.is_in(vocabulary, value_set=stop).to_numpy(zero_copy_only=False)[code] if len(code) else np.empty(0, bool)
    owner, code, of_text = owner[kept], code[kept], of_text[kept]

    def distinct(owner, code):
        """Distinct tokens of each row in order of first appearance, and their counts."""
        pair, at, count = np.unique(owner * max(1, len(vocabulary)) + code, return_index=True, return_counts=True)
        order = np.lexsort((at, owner[at]))
        return owner[at][order], code[at][order], count[order]

    row, token, count = distinct(owner[of_text], code[of_text])
    length = np.bincount(row, count, minlength=n).astype(np.int32)
    both, hashed, _ = distinct(owner, code)
    first, second = ((fnv1a(vocabulary, seed) % np.uint64(H.DIMS)).astype(np.int16)[hashed] for seed in (H.SEED_A, H.SEED_B))
    # Weights are counted in twentieths, so that sums are whole numbers.
    weight = H.UNIT * np.bincount(both * H.DIMS + first, minlength=n * H.DIMS)
    weight += round(second_weight * H.UNIT) * np.bincount(both * H.DIMS + second, minlength=n * H.DIMS)
    norm = np.sqrt((weight.reshape(n, H.DIMS) ** 2).sum(1) / (H.UNIT * H.UNIT))
    return pa.StructArray.from_arrays(
        [_lists(row, n, vocabulary.take(pa.array(token))), _lists(row, n, pa.array(count.astype(np.int32))),
         _lists(both, n, pa.array(first)), _lists(both, n, pa.array(second)), pa.array(length), pa.array(norm)],
        ["tokens", "counts", "first", "second", "length", "norm"])
