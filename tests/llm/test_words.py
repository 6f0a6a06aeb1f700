import random
import re

from varloom.llm import subjects, words


def test_words_and_sentences_against_regular_expressions():
    rng = random.Random(3)
    letters = "aAzZ09_ -.!?\n\t²ßéЖ東\u0301\U0001f600İ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["", "end.", "\ud800x"]
    low = [t.lower() for t in texts]
    codes, begins = words.code_points(low)
    for kind, pattern in (("word", r"[^\W_]+"), ("letter", r"[^\W\d_]+")):
        starts, ends = words.word_bounds(codes, kind)
        got = ["".join(map(chr, codes[a:b])) for a, b in zip(starts, ends)]
        want = [w for t in low for w in re.findall(pattern, t)]
        assert got == want
        hashes = words.word_hashes(codes, starts, ends).tolist()
        assert len(dict(zip(got, hashes))) == len(set(zip(got, hashes))) == len(set(hashes))
    of_doc, of_sentence, index = subjects.hashed_sentences(texts)
    sentences = [[len(w) for s in re.split(r"(?<=[.!?])\s", subjects.unnested(t).lower()) if (w := re.findall(r"[^\W\d_]+", s))] for t in texts]
    assert [b - a for a, b in zip(of_doc, of_doc[1:])] == list(map(len, sentences))
    assert [b - a for a, b in zip(of_sentence, of_sentence[1:])] == [2 * n - 1 for s in sentences for n in s] and of_sentence[-1] == len(index)


def test_empty():
    codes, begins = words.code_points([])
    assert len(codes) == len(begins) == 0 and len(words.word_bounds(codes, "word")[0]) == 0
