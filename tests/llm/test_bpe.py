import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from fathomix.llm.bpe import RankBPE

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pair():
    return RankBPE(PATH), Tokenizer.from_file(PATH)


def same(pair, text):
    own, library = pair
    want = library.encode(text, add_special_tokens=False).ids
    got = own.encode(text)
    assert got == want, repr(text)
    assert own.decode(got) == library.decode(want, skip_special_tokens=False), repr(text)


@pytest.mark.parametrize("text", ["", " ", "  ", "   a", "a   b", "a  b ", "x\n \nfoo", "x\n\n word", " \n ", "foo  ", "it's we'll", "<|endoftext|>a<|endoftext|> <|endoftext|>", " x   y", "\x1c a\x1c b", "日本語 テスト", "é ́", "🎉🎉", "a" * 3000, "x" * 200 + " " + "thing " * 400, "   a", "\t a\t\tb"])
def test_cases(pair, text):
    same(pair, text)


def test_random(pair):
    rng = random.Random(7)
    alphabet = list("ab  \n\t's'1! é́ßñ漢#<|>") + ["<|endoftext|>", " the", "ing", "\r\n", "  ", "\x1d"]
    for _ in range(1500):
        same(pair, "".join(rng.choice(alphabet) for _ in range(rng.randrange(30))))


def test_words_merge_together(pair, monkeypatch):
    """One by one they took more CPU time than all else."""
    own, _ = pair
    rng = random.Random(11)
    words = ["".join(rng.choice("abeinrst' éß漢🎉0") for _ in range(rng.randrange(1, 14))).encode() for _ in range(3000)]
    words += [b"a", b"aa" * 8, b"a" * 32, b"a" * 33, b"thing" * 60, b"\xff\xfe"]
    want = [tuple(own.merge_word(w)) for w in words]
    assert own.merge_words(words) == want
    assert own.merge_words([]) == []
    single = []
    monkeypatch.setattr(RankBPE, "merge_word", lambda self, raw: single.append(raw) or [0])
    fresh = RankBPE(PATH)
    texts = ["x " + " ".join(" ".join(w.decode() for w in words[i : i + 50] if len(w) < 32).split()) for i in range(0, 3000, 50)]
    assert len(list(fresh.encode_all(texts))) == 60
    assert not single


@pytest.mark.parametrize("half", [3, 400, 150_000])
def test_texts_together(monkeypatch, half):
    from fathomix.llm import bpe

    monkeypatch.setattr(bpe, "TEXTS", 7)
    monkeypatch.setattr(bpe, "CHARS", 2_000)
    own, library = RankBPE(PATH, half), Tokenizer.from_file(PATH)
    rng = random.Random(half)
    alphabet = list("abeinrst   \n'!1éßñ漢×ª·") + ["<|endoftext|>", " the", "ing", ".\n", "  ", "ſ", "ǅ", "ʰ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(90))) for _ in range(400)]
    texts += ["", " ", "x" * 300 + " word " + "y" * 64 + " " + "z" * 63, "unlike " * 900, "\ud800 a"[1:], "it's  two\n \nlines"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(own.encode_all(texts)) == want
    assert list(own.encode_all(texts)) == want
    assert [own.encode(t) for t in texts] == want
    assert max(map(len, (own._cache, own._cache.old, own._word_cache, own._word_cache.old))) <= half


def test_frames(spark):
    import hashlib

    from fathomix.llm import bpe

    rows = [(1, "hello world"), (2, None), (3, ""), (None, "null id"), (5, "x y " * 30_000), (1, "hello world")]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_tokens int")
    library = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [(None if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(df, PATH).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sorted((r.n_tokens, r.decoded) for r in bpe.encode_documents(df, PATH).collect()) == sorted((w[1], t or "") for w, (_, t) in zip(want, rows))
    assert bpe.encode_digests(df.limit(0), PATH).count() == 0
    assert bpe.encode_documents(df, PATH, decode=False).columns == ["doc_id", "n_tokens", "ids"]
