"""The byte-level transducer against the tokenizers library, in parts of any size, and its lookahead against extensions."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyglass.llm import byte_codec
from tallyglass.llm.byte_codec import Decoder, Encoder, Transducer, sufficient_lookahead, vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "\n\n x", "a  b\t\tc  ", "it's we'll 'tis they'RE ''re x'", "1234567 x²½ ١٢٣", "Étion çouelle ß ﬁ 漢字かな 🙂👩‍👩‍👧 é",
    "a<|endoftext|>b <|endoftext|><|endoftext", "<|<|endoftext|>|>", "\x00\x1f   x", "-" * 700, "ab" * 3000, " guaranteeing" * 400, "=" * 131 + " " * 9000 + "x",
    "x" * 20000 + "'s", " " * 5000, "9" * 6000 + "!" * 6000 + "\n" * 6000 + "ÄÖ" * 4000, "'" * 5000 + "re",
]
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


def in_parts(text, sizes):
    encoder, out, at, rng = Encoder(vocabulary(PATH)), [], 0, random.Random(len(text))
    while at < len(text):
        n = rng.choice(sizes)
        out.extend(encoder.feed(text[at : at + n]))
        at += n
    out.extend(encoder.finish())
    return list(memoryview(b"".join(out)).cast("i"))


@pytest.mark.parametrize("text", ODD, ids=range(len(ODD)))
def test_odd_texts(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert Encoder(vocabulary(PATH)).encode(text).tolist() == want
    for sizes in ([1, 2, 3], [7, 64], [1000, 5000]):
        assert in_parts(text, sizes) == want
    ids = Encoder(vocabulary(PATH)).encode(text)
    assert Decoder(vocabulary(PATH)).decode(ids) == library.decode(want, skip_special_tokens=False) == text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aeinst 'rlvedm\n\t.!12é漢🙂<|>")), max_size=60), st.integers(1, 5))
def test_random_texts_in_parts(text, size):
    assert in_parts(text, [size]) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_decoding_any_ids(library):
    rng = random.Random(3)
    for n in (1, 2, 5, 40):
        for _ in range(200):
            ids = [rng.randrange(256 if rng.random() < 0.7 else 50257) for _ in range(n)]
            decoder = Decoder(vocabulary(PATH))
            text = "".join(decoder.feed([i]) for i in ids) + decoder.finish()
            assert text == library.decode(ids, skip_special_tokens=False)


def test_both_merges_agree():
    v, rng = vocabulary(PATH), random.Random(5)
    for _ in range(300):
        data = bytes(rng.choice(b" guaranteeing-=eths") for _ in range(rng.randrange(1, 200)))
        assert v.merge_short(data) == v.merge_long(data)


def test_lookahead_of_a_small_merge_list():
    # abcd stays a|bcd, but abcde becomes ab|c|de: the e changes a token that ends four bytes before it
    chain = [(b"d", b"e"), (b"c", b"d"), (b"b", b"cd"), (b"a", b"b")]
    assert sufficient_lookahead(chain) == 4
    assert sufficient_lookahead([]) == 0
    assert sufficient_lookahead([(b"a", b"b")]) == 1


def test_no_extension_changes_a_stable_token():
    """Random proper merge lists: what is emitted at the lookahead stays, whatever follows; the bound is not far off."""
    rng, seen = random.Random(11), 0
    for _ in range(60):
        v = object.__new__(byte_codec.Vocabulary)
        letters = b"abc"
        tokens, merges = [bytes([x]) for x in letters], []
        for _ in range(rng.randrange(1, 14)):
            pair = rng.choice(tokens), rng.choice(tokens)
            if pair not in merges and pair[0] + pair[1] not in tokens:
                merges.append(pair)
                tokens.append(pair[0] + pair[1])
        ids = {t: i for i, t in enumerate(tokens)}
        v.single = [ids.get(bytes([b])) for b in range(256)]
        v.rank = {(ids[a], ids[b]): r for r, (a, b) in enumerate(merges)}
        v.merged = [ids[a + b] for a, b in merges]
        v.bytes = dict(enumerate(tokens))
        v.lookahead = sufficient_lookahead(merges)
        for _ in range(60):
            text = bytes(rng.choice(letters) for _ in range(rng.randrange(1, 40)))
            one, other = (v.merge(text + bytes(rng.choice(letters) for _ in range(rng.randrange(12)))) for _ in range(2))
            at = 0
            for a, b in zip(one, other):
                if at + len(tokens[a]) > len(text) - v.lookahead:
                    break
                assert a == b
                at += len(tokens[a])
            seen += at > 0
            for least in (1, v.lookahead + 1):
                t = Transducer(v)
                t.least = max(least, v.lookahead)
                out = [i for x in text for i in t.feed(bytes([x]))]
                assert out + t.finish() == v.merge(text)
    assert seen > 500


def test_memory_is_bounded():
    v = vocabulary(PATH)
    t = Transducer(v)
    for _ in range(2000):
        t.feed(b"abcdefghij" * 7)
        assert len(t.held) < 4 * v.lookahead
    e = Encoder(v)
    for _ in range(300):
        list(e.feed("x" * 997))
        assert len(e.carry) + len(e.tail) < 2 * byte_codec.LONG


def test_a_million_characters_in_one_pre_token(library):
    text = "abcdefg" * 150_000
    assert Encoder(vocabulary(PATH)).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_tables(spark, library):
    texts = [None, "", "same", "same", *ODD]
    rows = [(i if i != 2 else None, t, 7, 8) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, id int")
    out = byte_codec.digests(docs, PATH).collect()
    assert len(out) == len(rows)
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert byte_codec.digests(docs.limit(0), PATH).count() == 0
    ids = spark.createDataFrame([(1, None), (2, []), (3, [31373, None, 99_999_999, 995])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in byte_codec.decode(ids, PATH).collect()} == {1: None, 2: "", 3: "hello world"}


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        byte_codec.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_query(spark, library):
    from conftest import SMALL

    from tallyglass.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op12_byte_codec"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        assert got[d.doc_id].n_tokens == len(ids)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
