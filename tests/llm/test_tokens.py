import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewire.llm.elias_fano import EliasFano
from tidewire.llm.packing import encode_documents, pack
from tidewire.llm.token_files import Shard, read_token_files, write_token_files
from tidewire.llm.tokens import PieceEncoder, encoder
from tidewire.llm.word_bpe import WordBpe, encode_and_decode
from tidewire.session import shared_folder

from .conftest import TEXTS

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(str(p)) for p in (BYTES, WORDS)}


def ids(library, path, text):
    return library[path].encode(text or "", add_special_tokens=False).ids


def odd_texts():
    rng = random.Random(7)
    letters = "aAbeErt'sŚéİΣσé中😀01 <|endoftext|>\n\t#$.,ﬁ    "
    out = ["".join(rng.choices(letters, k=rng.randint(0, 50))) for _ in range(600)]
    out += ["".join(rng.choices("abcdeinorstu", k=rng.randint(1, 15))) for _ in range(3000)]
    out += ["a \n b", "a\n \nb", " \nb", "a ", " a", "", " ", "\n\n b", " " * 3000 + "x", "\n" * 2000, "ab" * 4000]
    return out + [t for _, t in TEXTS if t]


def test_pieces_are_the_librarys_ids(library):
    encoder = PieceEncoder(BYTES, cache_pieces=500)
    texts = odd_texts()
    got = [np.frombuffer(x, encoder.dtype).tolist() for i in range(0, len(texts), 97) for x in encoder.encode(texts[i : i + 97])]
    assert got == [ids(library, BYTES, t) for t in texts]


def test_speculative_bpe_is_exact(library):
    codec = WordBpe(WORDS, cache_pieces=800)
    texts = odd_texts()
    got = [x for i in range(0, len(texts), 97) for x in codec.encode(texts[i : i + 97])]
    for text, (n, joined, back) in zip(texts, got):
        want = ids(library, WORDS, text)
        assert (n, joined) == (len(want), " ".join(map(str, want)))
        assert back == library[WORDS].decode(want, skip_special_tokens=False)


def test_compatibility_agrees_with_merging():
    codec = WordBpe(WORDS)
    rng = np.random.default_rng(3)
    plain = np.array([i for t, i in codec.reachable.items() if not t.endswith("</w>")])
    a, b = rng.choice(plain, 4000), rng.choice(np.array(list(codec.reachable.values())), 4000)
    text = codec.text_of
    want = [codec.merge(codec._base(text[x]) + codec._base(text[y])) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert codec.compatible(a, b).tolist() == want and 0 < sum(want) < 4000


def test_encode_and_decode_rows(docs, no_docs, library):
    got = sorted(map(tuple, encode_and_decode(docs, WORDS).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in TEXTS:
        x = ids(library, WORDS, t)
        want.append((i, len(x), sha(" ".join(map(str, x))), sha(library[WORDS].decode(x, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    assert encode_and_decode(no_docs, WORDS).count() == 0


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0, 7], list(range(0, 5000, 3)), [5] * 2000 + [10**7], [0, 2**39]])
def test_elias_fano_round_trip(values):
    coded, end = EliasFano.from_bytes(b"xx" + EliasFano.encode(np.array(values, dtype=np.int64), (values or [0])[-1] + 1).to_bytes(), 2)
    assert coded.select(np.arange(len(values))).tolist() == values
    if values:
        assert coded.select([len(values) - 1, 0]).tolist() == [values[-1], values[0]]


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(0, 2000, 100_000))
    assert len(EliasFano.encode(values, int(values[-1]) + 1).to_bytes()) * 8 / len(values) < 2.3 + np.log2(1000) + 1


def test_shard_documents():
    blobs = [np.array(x, "<u2").tobytes() for x in ([1, 2], [], [3], [65535] * 5)]
    shard = Shard.from_bytes(Shard.of(blobs, [None, -3, 7, 2**50], np.dtype("<u2")).to_bytes())
    assert [shard.document(i).tolist() for i in range(4)] == [[1, 2], [], [3], [65535] * 5]
    assert shard.all_doc_ids() == [None, -3, 7, 2**50]
    with pytest.raises(ValueError):
        Shard.from_bytes(b"0" * 100)


def test_token_files(spark, docs, no_docs, library):
    path = shared_folder(spark, "t")
    write_token_files(docs, path, BYTES, end_id=2, shard_ids=700)
    got = [tuple(r) for r in read_token_files(spark.read.parquet(path)).orderBy("start").collect()]
    names = [r[0] for r in got]
    assert names == sorted(names, key=lambda x: (x is not None, x or 0))
    at = 0
    by_row = Counter()
    for doc, start, n, crc in got:
        assert start == at
        at += n
        by_row[doc, n, crc] += 1
    want = Counter()
    for i, t in TEXTS:
        x = [*ids(library, BYTES, t), 2]
        want[i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())] += 1
    assert by_row == want
    empty = shared_folder(spark, "t")
    write_token_files(no_docs, empty, BYTES)
    assert read_token_files(spark.read.parquet(empty)).count() == 0


@pytest.mark.parametrize("shard_ids", [300, 1 << 21])
def test_packing_places_every_id_once(spark, docs, no_docs, library, sf, shard_ids):
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for frame in (docs, real):
        source = [(r["doc_id"], [*ids(library, BYTES, r["text"]), 1]) for r in frame.select("doc_id", "text").collect()]
        rows = [r.asDict() for r in pack(frame, BYTES, size=256, shard_ids=shard_ids).collect()]
        whole = defaultdict(list)
        for doc, x in source:
            whole[doc, len(x)].append(x)
        pieces = Counter()
        for r in rows:
            fits = [x for x in whole[r["doc_id"], r["doc_tokens"]]]
            cut = [np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes() for x in fits]
            assert r["ids_crc32"] in {zlib.crc32(c) for c in cut}
            pieces[r["doc_id"], r["doc_tokens"]] += r["length"]
        assert pieces == Counter({k: k[1] * len(v) for k, v in whole.items()})
        windows = defaultdict(list)
        for r in rows:
            windows[r["sequence_id"]].append((r["offset"], r["length"]))
        short = 0
        for spans in windows.values():
            end = 0
            for offset, length in sorted(spans):
                assert offset == end
                end += length
            assert end <= 256
            short += end < 256
        assert short <= 8
    assert pack(no_docs, BYTES).count() == 0


def test_worker_processes_keep_no_pieces_after_packing(spark, docs):
    import pandas as pd

    path = str(BYTES)
    encode_documents(docs, shared_folder(spark, "pieces"), path)

    def kept(batches):
        for batch in batches:
            # An encoder that is there already is the one that encoded here.
            n = len(encoder(path).pieces) if encoder.cache_info().currsize else 0
            yield pd.DataFrame({"n": [n] * len(batch)})

    assert {r.n for r in spark.range(0, 64, 1, 8).mapInPandas(kept, "n long").collect()} == {0}
