import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gridsignal.llm.text import Words, ngrams, same_row

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x0c\rabABé  z,.", max_size=30)), max_size=8))
def test_words_match_split(texts):
    words = Words(pa.array(texts, pa.string()), lower=True)
    split = [(t or "").encode().translate(LOWER).split() for t in texts]
    assert words.counts().tolist() == [len(s) for s in split]
    flat = [w for s in split for w in s]
    assert [words.word(i) for i in range(len(flat))] == flat
    number = {}
    for w, h in zip(flat, words.number.tolist(), strict=True):
        assert number.setdefault(w, h) == h
    assert len(set(number.values())) == len(number)


def test_ngrams_are_equal_when_words_are():
    words = Words(pa.array(["a b c a b c d", "b c a", None, "c a b"]))
    three = ngrams(words.number, 3)[same_row(words, 3)].tolist()
    assert len(three) == 7
    assert three[0] == three[3] and three[1] == three[5] and three[2] == three[6]
    assert len(set(three)) == 4


def test_long_words_and_many_steps():
    text = ("x" * 3_000_000) + " end " + "y" * 10
    words = Words(pa.array([text, "end"]))
    assert words.counts().tolist() == [3, 1] and words.number[1] == words.number[3]
