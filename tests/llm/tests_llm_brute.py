"""Plain Python versions of the pipeline's stages."""

import re

from test_near_dedup import brute as near_brute
from test_pii import BASE, valid
from test_suffix_dedup import brute as suffix_brute


def near(rows, k, percent):
    return near_brute(rows, k, percent)[0]


def suffix(texts):
    """Every text without the words of passages that a smaller id has; emptied ones go."""
    _, cuts = suffix_brute([(k, t) for k, t in texts.items()])
    out = {}
    for key, text in texts.items():
        starts = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)] + [len(text)]
        drop = [(starts[i], starts[i + 1]) for i in sorted(cuts.get(key, ()))]
        kept = "".join(c for n, c in enumerate(text) if not any(a <= n < b for a, b in drop))
        if kept.strip() or not drop:
            out[key] = kept
    return out


def pii(text):
    spans = sorted((m.start(), list(BASE).index(kind), m.end(), kind) for kind, pattern in BASE.items()
                   for m in re.finditer(pattern, text) if valid(kind, m.group()))
    out, at = "", 0
    for start, _, end, kind in spans:
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]
