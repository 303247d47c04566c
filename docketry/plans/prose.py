"""Whole texts in Arrow columns: squashed, labelled by rules, summed up and quoted a batch at a time.

The patterns are those of the expressions. After ``squashed`` the only white space is single
blanks, and words of ASCII letters are looked for in ASCII-lowered text, so both pattern
dialects find the same.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docketry.functions import lexicon as L

_WHITE = r"\t\n\x0B\f\r\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACES = f"[ {_WHITE}]+"
_WIDE = _WHITE + r"\x00"
# Runs of white space other than one blank, which stays as it is.
_RUN = rf"[{_WIDE}][ {_WIDE}]*| [ {_WIDE}]+"
# Text that the rules of the dialects read alike: no groups with flags or looks, no classes, no edges.
_PLAIN = re.compile(r"(?:[^\\\[\](){}^$]|\\[sd.])*")
# Passes of ``SUMMARY_NOISE`` by a lower-cased piece without which they find nothing.
_NOISE = [(piece, re.compile(p, re.ASCII)) for piece, p in zip(
    ["cited", "decision", "judge", "issue", "filter", "'", None, "'"], L.SUMMARY_NOISE, strict=True)]


def _texts(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.string()), "")


# Texts of a batch that are worked on at a time, as a step holds several copies of them.
TURN = 1_000


def by_turns(work: Callable[[pa.Array], pa.Array], column: pa.Array) -> pa.Array:
    return pa.concat_arrays([work(column.slice(at, TURN)) for at in range(0, max(1, len(column)), TURN)])


def lowered(column: pa.Array) -> pa.Array:
    """Lower case; the one letter that becomes two is done apart."""
    return pc.utf8_lower(pc.replace_substring(column, "\u0130", "i\u0307"))


def squashed(column: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.replace_substring_regex(_texts(column), _RUN, " "), " ")


def portable(rules: Sequence[tuple[str, str]]) -> bool:
    """Rules that ``labels`` can take."""
    return all(_PLAIN.fullmatch(p) for _, p in rules)


def plain_words(anchors: Sequence[str]) -> bool:
    """Anchors that ``quoted`` can take."""
    return all(re.fullmatch(r"[A-Za-z0-9_]+([ |][A-Za-z0-9_]+)*", a) for a in anchors)


def labels(column: pa.Array, rules: Sequence[tuple[str, str]], default: str) -> pa.Array:
    """Label of the first rule whose pattern the lower-cased text holds."""
    low = lowered(_texts(column))
    place = np.full(len(low), len(rules))
    for i, (_, pattern) in enumerate(rules):
        # Only texts without a label so far are looked at.
        at = np.flatnonzero(place == len(rules))
        spaced = re.sub(r"\\.|\.", lambda m: {r"\s": r"[\s\x0B]", ".": r"[^\n\r\x{85}\x{2028}\x{2029}]"}.get(m[0], m[0]), pattern)
        hit = pc.match_substring_regex(low.take(pa.array(at)) if i else low, spaced).to_numpy(zero_copy_only=False)
        place[at[hit]] = i
    return pa.array([*[label for label, _ in rules], default], pa.string()).take(pa.array(place))


def _unnoised(text: str) -> str:
    low = text.lower()
    for piece, pattern in _NOISE:
        if piece is None or piece in low:
            text = pattern.sub(" ", text)
    return text


def _matches(column: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(column, pattern).to_numpy(zero_copy_only=False)


def summaries(column: pa.Array, cues: Sequence[tuple[int, str]]) -> pa.Array:
    """Three best sentences by cue words, at most 420 characters; equal scores keep text order."""
    source = _texts(column)
    noisy = _matches(pc.ascii_lower(source), r"cited|decision|judge|issue|filter|[{}\[\]']")
    if noisy.any():
        clean = pa.array([_unnoised(t) for t in source.filter(pa.array(noisy)).to_pylist()], pa.string())
        source = pc.replace_with_mask(source, pa.array(noisy), clean)
    text = squashed(source)
    # A squashed text has no line breaks.
    cut = text
    for sign in ".!?":
        cut = pc.replace_substring(cut, sign + " ", sign + "\n")
    parts = pc.split_pattern(cut, "\n")
    owner = np.repeat(np.arange(len(text)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    sentences = pc.list_flatten(parts)
    good = pc.greater(pc.utf8_length(sentences), 25).to_numpy(zero_copy_only=False)
    owner, sentences = owner[good], sentences.filter(pa.array(good))
    good = ~_matches(pc.ascii_lower(sentences), L.SUMMARY_JUNK.removeprefix("(?i)"))
    owner, sentences = owner[good], sentences.filter(pa.array(good))
    low = lowered(sentences)
    points = np.zeros(len(low), np.int64)
    for n, pattern in cues:
        points += n * _matches(low, pattern)
    points -= 2 * _matches(low, r"\b\d+\.\d+\b")
    named = pc.greater_equal(pc.count_substring(low, "v."), 3).to_numpy(zero_copy_only=False)
    points -= 2 * (named & pc.match_substring(low, "v. ").to_numpy(zero_copy_only=False))
    order = np.lexsort((np.arange(len(low)), -points, owner))
    start = np.searchsorted(owner, np.arange(len(text) + 1))
    order = order[np.arange(len(low)) - start[owner] < 3]
    offsets = np.concatenate([[0], np.cumsum(np.minimum(np.diff(start), 3))]).astype(np.int32)
    best = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), sentences.take(pa.array(order))), " ")
    plain = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_slice_codeunits(text, 0, 260), "[{}'\"]", ""), " ")
    return pc.case_when(
        pc.make_struct(pc.less(pc.utf8_length(text), 20), pc.not_equal(best, ""), pc.less(pc.utf8_length(plain), 30)),
        pa.scalar(L.SUMMARY_FALLBACK), pc.utf8_trim(pc.utf8_slice_codeunits(best, 0, 420), " "),
        pa.scalar(L.SUMMARY_FALLBACK), plain)


def quoted(column: pa.Array, anchors: Sequence[str], chars: int) -> pa.Array:
    """``chars`` characters of the squashed text from the first anchor in list order, or from its start."""
    text = squashed(column)
    low = pc.ascii_lower(text)
    at = np.full(len(text), -1, np.int64)
    for i, anchor in enumerate(anchors):
        left = np.flatnonzero(at < 0)
        part = low.take(pa.array(left)) if i else low
        at[left] = pc.find_substring_regex(part, rf"\b(?:{anchor.lower()})\b").to_numpy(zero_copy_only=False)
    # An anchor starts with an ASCII sign, so a place in the bytes is one between characters.
    found = [t[p:p + 4 * chars + 4].decode("utf-8", "ignore")[:chars] for t, p in
             zip(text.cast(pa.binary()).to_pylist(), np.maximum(at, 0).tolist())]
    return pc.utf8_trim(pa.array(found, pa.string()), " ")
