import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from countframe.llm import textarrays as ta
from tests.llm.helpers import ALNUM, LOWER, SPACE

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ é9.,-\t\n\x0bü\U0001F600", max_size=40)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    for classes, pattern in ((ta.NON_SPACE, SPACE), (ta.ALNUM, ALNUM)):
        seen, names = [], {}
        for block in ta.blocks(pa.array(texts, pa.string()), 16):
            w = ta.Words(block, classes)
            for r in range(block.n):
                spans = range(w.first[r], w.first[r + 1])
                got = [block.data[w.start[i]:w.end[i]].tobytes().decode().translate(LOWER) for i in spans]
                for i, word in zip(spans, got):
                    assert names.setdefault(int(w.hash[i]), word) == word      # equal hash, equal word
                seen.append(got)
        assert seen == [pattern.findall((t or "").translate(LOWER)) for t in texts]
        assert len(set(names.values())) == len(names)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=20), max_size=8), st.integers(1, 4))
def test_shingles_equal_iff_words_equal(texts, size):
    got = {}
    for block, first, h in ta.shingle_sets(pa.array(texts, pa.string()), size):
        for r in range(block.n):
            got[block.first + r] = h[first[r]:first[r + 1]]
    for i, a in enumerate(texts):
        w = a.split()
        assert len(got[i]) == len({tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else ())
        for j, b in enumerate(texts):
            v = b.split()
            sa = {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
            sb = {tuple(v[k:k + size]) for k in range(max(1, len(v) - size + 1))} if v else set()
            assert len(np.intersect1d(got[i], got[j])) == len(sa & sb)


def test_block_boundaries_do_not_matter():
    texts = pa.array(["one two three", None, "", "two three four " * 50, "é"])
    whole = [h for _, _, h in ta.shingle_sets(texts, 3)]
    parts = [ta.shingles(ta.Words(b, ta.NON_SPACE), 3) for b in ta.blocks(texts, 1)]
    assert set(np.concatenate(whole)) == set(np.concatenate([h for _, h in parts]))
