import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from counterloom.llm import arrays as A

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b\u2003 ", max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_windows_follow_the_pattern(texts):
    data, offsets = A.text_bytes(pa.array(texts, pa.string()))
    start, end, doc = A.words(data, offsets)
    got = [[bytes(data[a:b]).decode() for a, b, d in zip(start, end, doc, strict=True) if d == i] for i in range(len(texts))]
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert got == want
    hashes = A.span_hash(A.byte_prefix(data), start, end)
    of = A.doc_offsets(doc, len(texts))
    first, h = A.windows(hashes, of, 2)
    flat = [w for t in want for w in t]
    pairs = [tuple(t[i : i + 2]) for t in want for i in range(len(t) - 1)]
    assert [tuple(flat[i : i + 2]) for i in first] == pairs
    assert len(set(h.tolist())) == len(set(pairs))
    own = Counter(pairs)
    assert A.repeated(h).tolist() == [own[p] > 1 for p in pairs]


def test_slices_keep_all_rows_and_bound_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (3, 50, 0, 7, 200, 1)] + [None])], ["t"])
    parts = list(A.slices([batch.slice(1)], "t", limit=60))
    assert [x for p in parts for x in p.column("t").to_pylist()] == batch.column("t").to_pylist()[1:]
    assert len(parts) > 1
    data, offsets = A.text_bytes(batch.slice(2, 3).column("t"))
    assert np.diff(offsets).tolist() == [0, 7, 200] and len(data) == 207


def test_sliding_min_and_covered():
    v = np.array([5, 3, 8, 1, 9, 2], np.uint64)
    for w in range(1, 7):
        assert A.sliding_min(v, w).tolist() == [min(v[i : i + w]) for i in range(7 - w)]
    assert A.covered(np.array([1, 2]), 2, 6).tolist() == [False, True, True, True, False, False]


def thue_morse(n):
    """A string on which polynomials over 2**64 collide with its complement."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return ["".join("ab"[b ^ flip] for b in bits[:n]) for flip in (0, 1)]


def test_tokens_and_lines_of_colliding_words():
    import public_tokenizers
    from tokenizers import Tokenizer

    from counterloom.llm import packing, quality_rules

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, cached = Tokenizer.from_file(path), packing.CachedTokenizer(path)
    for n in (1024, 2048, 4096):
        one, two = thue_morse(n)
        texts = [one, two, f"{one} {two}", f"{two}\n{one}\n{two}"]
        ids, of = cached(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(of[:-1], of[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        counts = quality_rules._measure(pa.array(texts))
        assert counts["n_dup_lines"].tolist() == [0, 0, 0, 1]

