import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspan.llm import tokenize as t

tokenizers = pytest.importorskip("tokenizers")
VOCABULARY = t.DEFAULT_VOCABULARY
V = t.vocabulary(open(VOCABULARY, "rb").read())
OTHER = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
OTHER.encode_special_tokens = True


def same(texts):
    ids, n = V.encode(texts)
    got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [e.ids for e in OTHER.encode_batch(texts, add_special_tokens=False)]


def test_mixed():
    rng = random.Random(5)
    parts = ["a", "B", "é", "'", "'s", "'re", "'ll", "'LL", " ", "  ", "\n", "\t", " ", "　", "1", "٣", "²", "-", "!", "😀", "́", "日本", "'t", "<|endoftext|>", "\x1c", "​", "\u0085", "ß", "мир"]
    same(["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)] + ["日" * 3000, "ab" * 2000, "", " ", "\n\n\n"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_any_text(texts):
    same([x.encode("utf-8", "ignore").decode() for x in texts])


def test_scan_is_associative():
    rng = np.random.default_rng(0)
    sym = rng.integers(0, t.SYMBOLS, 5000).astype(np.uint8)
    state, want = t.FRESH, []
    for s in sym:
        want.append(state)
        state = t.STEP[s, state]
    for width in (1, 7, 256, 9999):
        assert t.scan_states(sym, width=width).tolist() == want


def test_frame(spark):
    rows = [(1, "Hello's  world", "clash"), (2, None, ""), (3, "", ""), (3, "", ""), (None, "x y", ""), (5, "long " * 100_000, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = t.encode(d, "doc_id", "text", offsets=True)
    got = out.collect()
    assert len(got) == 6 and sorted(len(r.ids) for r in got if r.doc_id in (2, 3)) == [0, 0, 0]
    for r in got:
        assert len(r.ids) == len(r.ends)
    one = next(r for r in got if r.doc_id == 1)
    assert one.ends[-1] == len(b"Hello's  world")
    back = {r.doc_id: r.text for r in t.decode(out, "doc_id", "ids").collect()}
    assert back == {1: rows[0][1], 2: "", 3: "", None: "x y", 5: rows[5][1]}
    counts = {r.doc_id: r.n_tokens for r in t.encode(d, "doc_id", "text", counts=True).collect()}
    assert counts[1] == len(one.ids) and counts[2] == 0
    assert t.encode(d.limit(0), "doc_id", "text").count() == 0
