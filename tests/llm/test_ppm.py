import math
import zlib
from collections import Counter, defaultdict

import pytest
from cases import CLASHES, documents, frame, prose

from sitegraph.llm import ppm


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def is_held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0


def brute(rows, order):
    """Scores by a dictionary of contexts, symbol by symbol with exclusion."""
    tries = [defaultdict(Counter) for _ in range(order + 1)]
    words = Counter()
    for doc, text in rows:
        if not is_held(doc):
            b = b"\xff" * order + lower(text) + b"\xfe"
            for i in range(order, len(b)):
                for k in range(order + 1):
                    tries[k][b[i - k:i]][b[i]] += 1
            words.update(lower(text).split() + [None])
    n, v = sum(words.values()), len(words)
    out = []
    for doc, text in rows:
        b, total = b"\xff" * order + lower(text) + b"\xfe", 0.0
        for i in range(order, len(b)):
            excluded: set = set()
            for k in range(order, -1, -1):
                seen = tries[k].get(b[i - k:i])
                if not seen:
                    continue
                left = {s: c for s, c in seen.items() if s not in excluded}
                size = sum(left.values())
                if b[i] in left:
                    total += math.log10((left[b[i]] - 0.5) / size)
                    break
                if left:
                    total += math.log10(len(left) / 2 / size)
                    excluded |= set(seen)
            else:
                total -= math.log10(255 - len(excluded))
        own = lower(text).split() + [None]
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        out.append((doc, is_held(doc), len(own), sum(words[w] > 0 for w in own), n, base, total))
    return out


def same(got, want):
    key = lambda r: (repr(r[0]), r[2], round(r[6], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


@pytest.mark.parametrize("order,chunk", [(4, 4000), (2, 1 << 20)])
def test_equals_brute_force(spark, order, chunk):
    rows = [(d, t if t is None else t[:6000]) for d, t in documents()] + [(100 + k, prose(k, 50)) for k in range(30)]
    docs = frame(spark, rows, CLASHES)
    same(ppm.ppm_scores(docs, order=order, chunk_bytes=chunk).collect(), brute(rows, order))


def test_without_training_documents(spark):
    rows = [(k, "abc") for k in range(200) if is_held(k)]
    same(ppm.ppm_scores(frame(spark, rows)).collect(), brute(rows, 4))


def test_empty_table(spark):
    assert ppm.ppm_scores(frame(spark).limit(0)).count() == 0

