from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siembra.llm import feature_digest as FD
from siembra.llm import license_scan as LS
from siembra.llm import pii_surrogates as PS
from siembra.llm import quality_classifier as QC
from siembra.llm import sentencepiece_codec as SP
from siembra.llm.components import connected_components
from siembra.llm.ngram_join import drop_near_copies, jaccard_matrix, near_classes, token_sets
from siembra.llm.repeated_passages import repeated_passages
from siembra.llm.shared import buffers
from siembra.llm.source_mix import integer_weights, mix_sources, mixed
from tests.conftest import DATA
from tests.llm.conftest import TEXTS

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
FOUR = str(DATA / "documents.parquet")


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x00-\x20]+", lower) if w]


def shingle_set(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_expected(rows, similarity=0.8):
    """Brute force: class and links of every row."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if sets[a] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    return sorted(((i, min(least[find(k)], default=None), links[k]) for k, (i, _) in enumerate(rows)), key=str)


def family(n, size=60, changes=1):
    base = [f"w{k}" for k in range(size)]
    out = []
    for k in range(n):
        w = list(base)
        for c in range(changes if k else 0):
            w[(7 * k + 29 * c) % size] = f"x{k}{c}"
        out.append((100 + k, " ".join(w)))
    return out


class TestNearClasses:
    def test_hard_rows(self, docs, clashing):
        for df in (docs, clashing):
            got = near_classes(df).collect()
            assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == near_expected(TEXTS)

    def test_smoke_documents(self, spark):
        df = spark.read.parquet(FOUR)
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        got = near_classes(df).collect()
        assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == near_expected(rows)

    def test_large_family(self, spark):
        rows = family(40)
        got = near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == near_expected(rows)

    def test_splitting_large_buckets(self, spark, monkeypatch):
        from siembra.llm import ngram_join

        monkeypatch.setattr(ngram_join, "BUCKET", 8)
        monkeypatch.setattr(ngram_join, "LAST", 8)
        monkeypatch.setattr(ngram_join, "TILE", 16)
        rows = family(60, changes=2) + [(500 + k, " ".join(f"y{k}_{j}" for j in range(30))) for k in range(40)]
        got = near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == near_expected(rows)

    def test_empty(self, empty):
        assert near_classes(empty).collect() == []

    def test_one_of_each_class_stays(self, spark):
        rows = family(12) + [(1, "quite another text with a few words")]
        got = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
        classes = {c for _, c, _ in near_expected(rows)}
        assert sorted(r["doc_id"] for r in got.collect()) == sorted(classes)

    def test_jaccard_matrix(self):
        texts = ["a b c d e f", "a b c d e g", "z"]
        tokens, offsets = token_sets(*buffers(pa.array(texts)), 5)
        assert np.allclose(jaccard_matrix(tokens, offsets)[0, 1], 1 / 3)


@pytest.mark.parametrize("most", [4, 1 << 20])
def test_components(spark, most):
    edges = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 20)] + [(7, 7), (None, 3), (101, 100)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "u long, v long").repartition(5), most).collect()}
    assert got == {k: 0 for k in range(31)} | {100 + k: 100 for k in range(20)}


class TestMix:
    def test_windows_and_deviation(self, spark):
        sizes = {"a": 3000, "b": 1200, "c": 500, None: 300}
        rows = [(k, s) for s, n in sizes.items() for k in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("mix_slot", F.lit("clash"))
        got = mix_sources(df, {"a": 5, "b": 3, "c": 1.5, None: 0.5}, period=100, block_size=10).toPandas()
        assert len(got) == len(rows)
        inside = got[got.in_mix]
        blocks = inside.drop_duplicates(["source", "mix_block"]).sort_values("mix_slot")
        assert blocks.mix_slot.tolist() == list(range(len(blocks)))
        assert ((blocks.mix_release <= blocks.mix_slot) & (blocks.mix_slot < blocks.mix_deadline)).all()
        assert (inside.groupby(["source", "mix_block"], dropna=False).size() == 10).all()
        for s, w in (("a", 50), ("b", 30), ("c", 15)):
            ahead = (blocks.source == s).cumsum().to_numpy() - np.arange(1, len(blocks) + 1) * w / 100
            assert np.abs(ahead).max() < 1

    def test_edges(self, empty, docs):
        assert mix_sources(empty.withColumn("source", F.lit("x"))).collect() == []
        one = mix_sources(docs.withColumn("source", F.lit("x")), block_size=4).toPandas()
        assert sorted(one.mix_rank) == list(range(len(TEXTS)))
        assert mixed(docs.withColumn("source", F.lit("x")), block_size=1).count() == len(TEXTS)
        with pytest.raises(ValueError, match="period"):
            integer_weights({k: 1 for k in range(11)}, 10)
        assert sum(integer_weights({"a": 1e-9, "b": 1}, 10).values()) == 10


class TestPieces:
    @pytest.fixture
    def library(self):
        sentencepiece = pytest.importorskip("sentencepiece")
        return sentencepiece.SentencePieceProcessor(model_file=MODEL)

    def test_ids_of_the_library(self, spark, docs, library):
        for df in (docs, spark.read.parquet(FOUR)):
            for r in SP.encode_pieces(df.withColumn("ids", F.lit("clash")), MODEL, keep=("doc_id", "text", "ids")).collect():
                assert list(r["ids"]) == library.encode(r["text"] or "")
                assert r["round_trip"]

    def test_odd_texts(self, library):
        codec = SP.Codec(SP.Vocabulary.load(MODEL))
        odd = ["", " ", "  a  b   c", "x\n\n\ny \n z", "aaaaaaaaaaaa", "\t\ttab", "the▁mark", "नमस्ते 😀", "é" * 300, "\x00\x01"]
        ids, where = codec.encode(odd)
        assert [ids[a:b].tolist() for a, b in zip(where[:-1], where[1:], strict=True)] == library.encode(odd)

    def test_unigram_is_viterbi(self):
        sentencepiece = pytest.importorskip("sentencepiece")
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(Path(MODEL).read_bytes())
        proto.trainer_spec.model_type = 1
        for piece in proto.pieces:  # ranks as moderate scores: the library adds in single precision
            if piece.type == 1:
                piece.score = max(piece.score / 1000, -100.0)
        model = proto.SerializeToString()
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        codec = SP.Codec(SP.Vocabulary(model))
        texts = ["the quick brown fox", "interactions between models", "ein schönes Wort", "unbelievable"]
        ids, where = codec.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(where[:-1], where[1:], strict=True)] == library.encode(texts)

    def test_decode(self, docs, empty):
        back = {(r["doc_id"], r["text"]) for r in SP.decode_pieces(SP.encode_pieces(docs, MODEL), MODEL).collect()}
        assert back == {(i, t or "") for i, t in TEXTS}
        assert SP.encode_pieces(empty, MODEL).collect() == []


class TestDigest:
    def test_windows_by_definition(self):
        rng = np.random.default_rng(1)
        data = rng.integers(97, 104, 400).astype(np.uint8)
        whole = int(FD._XLOGX[FD.WINDOW])
        slow = [(whole - int(FD._XLOGX[np.bincount(data[k : k + FD.WINDOW], minlength=256)].sum())) * (FD.BINS - 1) // whole for k in range(len(data) - FD.WINDOW + 1)]
        assert FD.entropy_bins(data).tolist() == slow

    def test_equal_texts_equal_fingerprints_anywhere(self):
        ranks = np.arange(FD.BINS)
        texts = ["short", "a" * 31, "The river runs. " * 9 + str(list(range(90))), "", "x y z " * 40]
        alone = [FD.Digests.of_texts([t], ranks).strings()[0] for t in texts]
        assert FD.Digests.of_texts(texts[::-1], ranks).strings()[::-1] == alone
        d = FD.Digests.of_texts(texts, ranks)
        assert FD.likeness(d, d).tolist() == [1.0] * len(texts)

    def test_neighbours(self, docs, clashing, empty):
        order = sorted(TEXTS, key=lambda r: (r[0] is None, -(r[0] or 0)))
        ranks = FD.corpus_ranks(docs)
        for df in (docs, clashing):
            got = {}
            for r in FD.compare_with_next(df, ranks).collect():
                got.setdefault(r["doc_id"], []).append(r)
            for k, (i, t) in enumerate(order):
                t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
                edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
                if i != 1:  # rows of id 1 are ties
                    (r,) = got[i]
                    assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
                    assert r["fingerprint"] == FD.Digests.of_texts([t], ranks).strings()[0]
                    assert r["edited_fingerprint"] == FD.Digests.of_texts([edited], ranks).strings()[0]
            assert len(got[1]) == 2
        assert FD.compare_with_next(empty, ranks).collect() == []
        (alone,) = FD.compare_with_next(docs.where("doc_id = 3"), ranks).collect()
        assert alone["near_next"] == 1.0

    def test_edited_is_nearer_than_the_next(self, spark):
        df = spark.read.parquet(FOUR)
        got = FD.compare_with_next(df, FD.corpus_ranks(df)).where("n_chars > 1000").toPandas()
        assert (got.near_edited > got.near_next).mean() > 0.99


class TestPassages:
    def test_against_brute_force(self, spark):
        df = spark.read.parquet(FOUR)
        rows = df.select("doc_id", "text").collect()
        w = {r["doc_id"]: words(r["text"]) for r in rows}
        seen = defaultdict(set)
        for k, x in w.items():
            for i in range(len(x) - 49):
                seen[tuple(x[i : i + 50])].add(k)
        expected = {(k, i + j) for k, x in w.items() for i in range(len(x) - 49) if len(seen[tuple(x[i : i + 50])]) > 1 for j in range(50)}
        got = {(r["doc_id"], i) for r in repeated_passages(df).collect() for i in range(r["start_word"], r["end_word"])}
        assert got == expected

    def test_planted_in_many_documents(self, spark):
        passage = " ".join(f"p{k}" for k in range(55))
        rows = [(k, f"{' '.join(f'a{k}_{j}' for j in range(k % 40))} {passage} {' '.join(f'b{k}_{j}' for j in range(30))}") for k in range(200)] + [(1000, " ".join(f"c{j}" for j in range(300))), (None, None)]
        got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r["doc_id"], r["start_word"], r["n_words"]) for r in got) == sorted((k, k % 40, 55) for k in range(200))

    def test_hard_rows(self, docs, empty):
        assert repeated_passages(docs).collect() == []
        assert repeated_passages(empty).collect() == []


class TestLicenses:
    def test_alignment(self):
        a, b = "x a b c d e y".split(), "a b z c d e".split()
        names = {w: k for k, w in enumerate(sorted({*a, *b}))}
        assert LS.align([names[w] for w in a], [names[w] for w in b]) == [(1, 0), (2, 1), (3, 3), (4, 4), (5, 5)]

    def test_found_in_whole_texts(self, spark, docs, empty):
        filler = " ".join(f"w{k}" for k in range(5000))
        mit = LS.TEMPLATES["MIT"].replace("Software", "Program", 1)
        rows = [(1, f"{filler} {mit} {filler}"), (2, f"{filler} {LS.TEMPLATES['GPL-3.0-notice']}"), (3, filler), (4, None)]
        got = {(r["doc_id"], r["license"]): r for r in LS.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert set(got) == {(1, "MIT"), (2, "GPL-3.0-notice")}
        assert got[1, "MIT"]["start_word"] == 5000
        assert 0.95 < got[1, "MIT"]["coverage"] < 1
        assert LS.scan_licenses(docs).collect() == []
        assert LS.scan_licenses(empty).collect() == []


class TestSurrogates:
    TEXT = "Mr. John Smith (john.smith@mail.example.com, +1 (499) 555-6503) and Ms. Smith paid 4111 1111 1111 1111 from 10.0.0.1; token = \"0123456789abcdef0123\"."

    def test_types_and_coreference(self, spark):
        rows = [(1, self.TEXT), (2, self.TEXT.upper()), (3, "John Smith again: john.smith@mail.example.com"), (4, "nothing here 12 and 1.2.3"), (5, None)]
        got = {r["doc_id"]: r for r in PS.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
        new = got[1]["text"]
        for secret in ("John", "Smith", "john.smith", "499", "4111 1111", "10.0.0.1", "0123456789abcdef"):
            assert secret not in new
        assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}\)", new)
        card = re.search(r"\d{4} \d{4} \d{4} \d{4}", new)[0]
        assert PS.luhn(card.replace(" ", ""))
        first, last = re.search(r"Mr\. (\w+) (\w+)", new).groups()
        assert f"Ms. {last} paid" in new
        assert got[3]["text"].startswith(f"{first} {last} again")
        assert re.search(r"\S+@\S+", got[3]["text"])[0] in new
        assert got[4]["text"] == rows[3][1]
        assert (got[5]["text"], got[5]["n_entities"]) == ("", 0)
        assert PS.surrogate(b"a", "ip", "10.0.0.1") != PS.surrogate(b"b", "ip", "10.0.0.1")

    def test_distinct_even_where_shapes_are_few(self, spark):
        rows = [("email", f"{a}@b.co") for a in "abcdefghijklmnopqrst"] + [("ssn", f"000-00-{k:04d}") for k in range(300)]
        rows = [(k, c.replace("-", "") if k == "ssn" else c) for k, c in rows]
        later = {(r["kind"], r["canon"]): r["attempt"] for r in PS.assign(spark.createDataFrame(rows, "kind string, canon string"), b"k").collect()}
        made = [(k, PS.surrogate(b"k", k, c, later.get((k, c), 0))) for k, c in rows]
        assert len(set(made)) == len(made)
        assert not set(made) & set(rows)

    def test_hard_rows(self, clashing, empty):
        got = PS.pseudonymise(clashing, "k").collect()
        assert sorted((r["text"] for r in got)) == sorted(t or "" for _, t in TEXTS)
        assert PS.pseudonymise(empty, "k").collect() == []


class TestQuality:
    def test_held_out_accuracy(self, spark):
        folder = str(DATA.parent / "sf0.01")
        docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
        model = QC.fit_quality(docs, labels)
        got = QC.score_quality(docs, model).join(labels, "doc_id").where("held_out").toPandas()
        assert ((got.predicted == 1) == (got.quality == 1)).mean() > 0.95
        assert got.score.between(0, 1).all()

    def test_gradient(self):
        rng = np.random.default_rng(0)
        texts = ["good plain words in a row " * 9, "BAD!!! ### " * 30, "mixed " * 3] * 8
        bags = QC.encode_passages(*buffers(pa.array(texts)))
        labels = np.array([1.0, 0.0, 1.0] * 8)
        model = QC.fit(bags, labels, steps=80)
        assert ((QC.score(model, bags) > 0.5) == (labels == 1)).all()
        del rng

    def test_passages_dont_depend_on_the_chunk(self):
        texts = ["", "one", "word " * 200, "   ", "Ünï 日本 " * 70]
        together = QC.encode_passages(*buffers(pa.array(texts)))
        for k, t in enumerate(texts):
            alone = QC.encode_passages(*buffers(pa.array([t])))
            assert np.allclose(alone.features, together.features[together.offsets[k] : together.offsets[k + 1]])

    def test_hard_rows(self, spark, docs, empty, clashing):
        none = spark.createDataFrame([], "doc_id long, quality int")
        assert QC.fit_quality(docs, none) is None
        assert {r["score"] for r in QC.score_quality(docs, None).collect()} == {0.5}
        labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (6, 0), (7, 1), (None, 1), (8, None)], "doc_id long, quality int")
        model = QC.fit_quality(clashing, labels)
        assert QC.score_quality(clashing, model).count() == len(TEXTS)
        assert QC.score_quality(empty, model).collect() == []
        assert QC.keep_quality(clashing, model).columns == clashing.columns
