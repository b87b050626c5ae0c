"""Token caches, merge dropout, compression bands and token files against the libraries and brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from surveyspark.llm.bands import Bands, base_counts, compression_bands
from surveyspark.llm.bytesets import mix
from surveyspark.llm.common import new_folder
from surveyspark.llm.counts import CACHE, token_counts
from surveyspark.llm.merges import MergeEncoder, decode_pieces, encode_pieces
from surveyspark.llm.tokens import CachedEncoder
from surveyspark.llm.wavelet import WaveletMatrix, read_token_files, write_token_files

ODD = ["", "  ", " a  b\n c ", "it's 'S don't I'LL ''s x'y", "Héllo—wörld “q” ...”.   x y\n  f", "a\n\n b \n\nfoo \n c\t\td  e", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|> A",
       "H̱ é É K ſ İ ß", "日本語 テキスト。abc123,45", "x" * 3000, "1 22 333 ½ ²³ ٣٤", "\x1c a\x1db \x85 c\x85 d", "🙂🙂 é!…?", "trail ", "\n", "a \n"]
ROWS = [(i, t, "clash") for i, t in enumerate(ODD)] + [(100, None, None), (3, ODD[3], "clash"), (None, "no id here", "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, kept string").repartition(3)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_ids_equal_the_library(name):
    rng = random.Random(1)
    bits = ["a", "B", "é", " ", "  ", "\n", "'", "s", "'s", "1", "½", ".", "—", " ", "\t", "́", "<|endoftext|>", "日", "　", "\x1f", "🙂", "_", "Word", " the"]
    texts = ODD + ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(5000)]
    coder = CachedEncoder(name, limit=500)
    got = [x for i in range(0, len(texts), 700) for x in coder.encode([t.encode() for t in texts[i:i + 700]])]
    want = coder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in want]


def test_words_are_learnt_once():
    """A word goes to the library once, whatever marks and line ends stand around it."""
    coder = CachedEncoder("byte_bpe_50k.json")
    library, seen = coder.tokenizer, []

    class Counting:
        def encode_batch_fast(self, texts, **kw):
            seen.extend(texts)
            return library.encode_batch_fast(texts, **kw)

    coder.tokenizer = Counting()
    text = "".join(f" zanzibar{a}{b} zanzibar{a}\nzanzibar" for a in ".,;:!?" for b in ("", "!", "$$$", ")"))
    (got,) = coder.encode([text.encode()])
    assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum(t.count("zanzibar") for t in seen) == 2  # with a space and with a line feed before it
    # were two stretches of one hash, the ids would not give the text, which then goes to the library whole
    coder.flat = coder.flat[::-1].copy()
    assert coder.encode([text.encode()]) == [got]


def test_token_counts_and_cache(spark, odd):
    cache = new_folder(spark, "cache")
    first = token_counts(odd, cache).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in first:
        assert r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids)
    assert Counter((r["doc_id"], r["text"], r["kept"]) for r in first) == Counter(ROWS)
    stored = spark.read.schema(CACHE).parquet(cache).count()
    assert stored == len({t or "" for _, t, _ in ROWS})  # each distinct content was encoded once
    more = odd.union(spark.createDataFrame([(7, "brand new words", "")], odd.schema))
    again = token_counts(more, cache).collect()
    assert len(again) == len(ROWS) + 1 and spark.read.schema(CACHE).parquet(cache).count() == stored + 1
    assert token_counts(odd.limit(0), cache).collect() == []


@pytest.mark.parametrize("dropout", [0.0, 0.3, 1.0])
def test_merges(dropout):
    coder = MergeEncoder("piece_bpe_32k.model", dropout, 5, wide=12)
    texts = ODD + ["plain words of a text " * 9, "▁x ▁", "unbrokenunbrokenunbroken" * 4, "<0x0A> <s> <unk>"]
    ids = coder.encode(texts, range(len(texts)))
    assert coder.decode(ids) == [t.replace("▁", " ") for t in texts]
    lists = [np.frombuffer(x, "<u4").tolist() for x in ids]
    if dropout == 0:
        assert lists == coder.sp.encode([t.replace("▁", " ") for t in texts])
    if dropout == 1:
        assert all(len(coder.sp.id_to_piece(i)) == 1 or coder.sp.is_byte(i) for x in lists for i in x)
    words = sorted({w.replace(" ", "▁") for t in texts for w in re.findall(r" ?[^ \n]+", t)})
    assert coder._together(words, 0) == [coder._alone(w, 0) for w in words]


def test_candidates_of_many_stretches_at_once():
    """All places of all stretches are looked up side by side; each has what a search of its substrings finds."""
    coder = MergeEncoder("piece_bpe_32k.model", 0.1, 3, keep_mark=True)
    words = [" the", " ", "", "   ", " Straße", " \U0001f600x", " in▁the", " " + "na" * 40, " internationalisation"]
    got = coder._possible(words)
    for w, x in zip(words, got):
        text = w.replace("▁", "\0").replace(" ", "▁")
        want = [a << 20 | coder.merged[text[a:e]] for a in range(len(w)) for e in range(a + 2, len(w) + 1) if text[a:e] in coder.merged]
        if len(w) > coder.wide or len(want) > 64:
            assert x is None
        else:
            assert sorted(x.tolist()) == sorted(mix(np.array(want, np.uint64)).tolist())
    assert any(x is not None and len(x) > 5 for x in got)


def test_each_occurrence_draws():
    coder = MergeEncoder("piece_bpe_32k.model", 0.1, 5, keep_mark=True)
    text = "wonderful " * 3000
    ids = coder.encode([text, text, "▁x ▁"], [1, 2, 3])
    assert ids[0] != ids[1] and coder.decode(ids) == [text, text, "▁x ▁"]
    words = ["wonderful"] * 3000
    got = {coder._alone(" " + w, key) for key, w in enumerate(words)}
    assert len({x for w, x in coder.known.items() if w[0] == " wonderful"} & got) > 4
    again = MergeEncoder("piece_bpe_32k.model", 0.1, 5, limit=3, keep_mark=True)  # nothing kept: the same ids
    assert again.encode([text[:500]], [2]) + again.encode([text], [1]) == coder.encode([text[:500]], [2]) + [ids[0]]
    keys = mix(mix(np.arange(500, dtype=np.uint64)))  # skips and segmentation agree with the agenda of each key alone
    pieces = coder._segment([" wonderful"] * 500, keys)
    assert pieces == [coder._alone(" wonderful", int(k)) for k in keys]


def test_only_decisions_that_matter_are_told_apart():
    """A skipped candidate that never comes to the top changes nothing, so it needs no agenda of its own."""
    coder = MergeEncoder("piece_bpe_32k.model", 0.1, 5, keep_mark=True)
    text = "international " * 5000 + "x" * 50
    ids = coder.encode([text, "x" * 60, ""], [1, 2, 3])
    assert coder.decode(ids) == [text, "x" * 60, ""]
    assert len([w for w, _ in coder.known if w == " international"]) < 1000
    fresh = MergeEncoder("piece_bpe_32k.model", 0.1, 5, keep_mark=True)
    assert fresh.encode(["x" * 60, text], [2, 1]) == ids[1::-1]


def test_merge_rows(spark, odd):
    rows = decode_pieces(encode_pieces(odd, dropout=0.2, seed=3, carry=["doc_id", "text", "kept"])).collect()
    assert Counter((r["doc_id"], r["text"], r["kept"]) for r in rows) == Counter(ROWS)
    assert all(r["decoded"] == (r["text"] or "") for r in rows)
    seeds = [{(r["doc_id"], r["text"]): bytes(r["ids"]) for r in encode_pieces(odd, dropout=0.2, seed=s, carry=["doc_id", "text"]).collect()} for s in (3, 3, 4)]
    assert seeds[0] == seeds[1] != seeds[2]
    assert encode_pieces(odd.limit(0)).collect() == []


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    lines, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in lines
            lines.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_bands(spark, odd):
    rng = random.Random(2)
    for t in ODD + [" ".join(rng.choices(["a", "b", "c#", "é"], k=rng.randint(0, 80))) + rng.choice(["", "\n\na b\na b\n \n"]) for _ in range(300)]:
        assert base_counts(t) == slow_counts(t)
    prose = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(900))
    noise = "".join(chr(rng.randint(48, 111)) + (" " if i % 60 == 0 else "") for i in range(9000))
    texts = [(1, prose), (2, "the same line of text again and on " * 200), (3, noise), (4, None), (5, prose[:120])]
    rows = {r["doc_id"]: r for r in compression_bands(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [rows[i]["kept"] for i in range(1, 6)] == [True, False, False, False, True]
    assert rows[2]["ratio"] < 0.1 and rows[3]["ratio"] > 0.7 and rows[3]["bad_chunks"] == rows[3]["n_chunks"]
    assert rows[4]["base_failed"] and rows[4]["ratio"] == 1
    assert Bands().limits(100) is None
    assert len(compression_bands(odd, carry=["doc_id"]).collect()) == len(ROWS)
    assert compression_bands(odd.limit(0), carry=["doc_id"]).collect() == []


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n, top in ((1, 1), (500, 7), (3000, 50257), (70, 1), (0, 5)):
        x = rng.integers(0, top, n).astype(np.uint32)
        starts = np.arange(0, n, 10)
        m = WaveletMatrix.from_bytes(WaveletMatrix.build(x, np.arange(len(starts)) * 3, starts).to_bytes())
        assert np.array_equal(m.tokens(), x) and np.array_equal(m.access(np.arange(n)), x)
        for token in sorted({*x[:20].tolist(), top, 99999}):
            at = np.flatnonzero(x == token)
            assert m.count(token) == len(at) and m.count(token, n // 3, n // 2) == ((at >= n // 3) & (at < n // 2)).sum()
            assert m.rank(token, np.arange(n + 1)).tolist() == np.append(0, np.cumsum(x == token)).tolist()
            if len(at):
                assert m.select(token, np.arange(len(at))).tolist() == at.tolist()
        if n:
            assert m.document(0).tolist() == x[:10].tolist()


def test_token_files(spark, odd):
    rows = [(i, t) for i, t, _ in ROWS if i is not None]
    path = new_folder(spark, "files")
    write_token_files(odd.filter("doc_id is not null"), path, shard_tokens=40)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, read_token_files(spark, path).collect())) == want
    path = new_folder(spark, "files")
    write_token_files(odd.limit(0), path)
    assert read_token_files(spark, path).collect() == []
    with pytest.raises(Exception, match="without an id"):
        write_token_files(odd, new_folder(spark, "files"))


def test_sentencepiece_is_there():
    assert sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")).get_piece_size() == 32000
