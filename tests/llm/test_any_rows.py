"""Ids of any kind, names that operators use for themselves, failures, and the pipeline's stages on odd rows."""

from __future__ import annotations

import inspect
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from staylens.llm import bpe, decontaminate, lexical, licences, lines, mixing, passages, shards, simhash, toxicity, whitening
from staylens.llm import embeddings, frames, licence_texts
from staylens.llm.queries import byte_vocabulary
from tests.llm import brute
from tests.llm.test_scans import BENCHMARK, passage_rows, same

LINE = "this line stands in more than one document"


def line_rows(found):
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()


def random_ids(n):
    rng = random.Random(4)
    return [rng.randrange(-(2**63), 2**63) for _ in range(n)]


@pytest.mark.parametrize("batches", [1, 4, 7])
@pytest.mark.parametrize("ids", [
    [0, 1, 2, 2**62],
    [-(2**63), -(2**63) + 1, -1, 0, 1, 2**63 - 2, 2**63 - 1],
    sorted(random_ids(6)),
    random_ids(1000),
], ids=["sparse", "extremes", "few", "random"])
def test_lines_of_any_ids(spark, ids, batches):
    rng = random.Random(5)
    rows = [(doc, "\n".join(rng.sample([LINE, LINE.upper() + " ", "other line that is long enough", str(doc) * 9, "x"], 3)))
            for doc in ids[3:]]
    rows += [(doc, LINE) for doc in ids[:3]] + [(None, LINE)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(line_rows(lines.drop_repeated_lines(frame, batches=batches)), brute.lines(rows))


def run_tables(spark):
    return [t.tableName for t in spark.sql("SHOW TABLES").collect() if t.tableName.startswith("staylens_run")]


def test_failed_runs_leave_no_tables(spark, odd, monkeypatch):
    def fail(runs):
        raise RuntimeError("made to fail")

    lines.repeated_lines(odd, batches=4)
    assert run_tables(spark) == []
    monkeypatch.setattr(lines, "_merged", fail)
    with pytest.raises(RuntimeError, match="made to fail"):
        lines.repeated_lines(odd, batches=4)
    assert run_tables(spark) == []


def with_inner_names(frame, *modules):
    """The frame with a text column for every name in quotes that the modules' code uses for itself."""
    own = {c.lower() for c in frame.columns}
    names = {n for m in (*modules, frames) for n in re.findall(r'"(_[a-z][a-z_]*|[a-z]{2,})"', inspect.getsource(m))}
    for name in sorted(names - own):
        frame = frame.withColumn(name, F.lit("x"))
    return frame.withColumn("_keep_0", F.lit("x")).withColumn("_in_0", F.lit("x"))


def test_inner_names_as_columns(spark, odd, odd_rows):
    documents = odd.select("doc_id", "text", "lang", "source", "n_chars")
    wide = with_inner_names(documents, lines)
    found = lines.drop_repeated_lines(wide)
    assert {"_line_id", "_line_hash", "_line_keys"} <= set(found.columns)
    same(line_rows(found), brute.lines(odd_rows))
    found = simhash.near_duplicates(with_inner_names(documents, simhash))
    assert "_fp" in found.columns
    same(found.select("doc_id", simhash.hex_digits(), "component_id").collect(), brute.near_texts(odd_rows))
    found = passages.drop_passages(with_inner_names(documents, passages), length=16, gram=4)
    assert {"_tid", "_spans", "_copied"} <= set(found.columns)
    same(found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect(),
         brute.passages_removed(odd_rows, 16))
    items = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    wide = with_inner_names(documents, decontaminate)
    same(passage_rows(decontaminate.find_passages(wide, items)), brute.passages(odd_rows, BENCHMARK))
    same(lexical.rank_documents(with_inner_names(documents, lexical), items).collect(), brute.ranked(odd_rows, BENCHMARK))
    assert mixing.mix(with_inner_names(documents, mixing)).count() == len(odd_rows)
    assert shards.shard(with_inner_names(documents, shards), 3).count() == len(odd_rows)
    assert bpe.round_trip_digests(with_inner_names(documents, bpe), byte_vocabulary()).count() == len(odd_rows)
    model = toxicity.train(toxicity.Sample([]))
    assert toxicity.score_texts(with_inner_names(documents, toxicity), model).count() == len(odd_rows)
    scanned = licences.scan_licences(with_inner_names(documents, licences), licence_texts.NAMES, licence_texts.NOTICES)
    assert scanned.count() == len(odd_rows)
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.1]), (None, [5.0, -1.0])], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(with_inner_names(vectors, embeddings)).count() == 3
    assert whitening.whiten(with_inner_names(vectors, whitening)).count() == 3


def test_session_settings_stay(spark, odd, empty):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "777")
    try:
        items = spark.createDataFrame(BENCHMARK, "item_id long, text string")
        lines.drop_repeated_lines(odd).collect()
        simhash.near_duplicates(odd).collect()
        passages.drop_passages(odd).collect()
        decontaminate.find_passages(odd, items).collect()
        lexical.rank_documents(odd, items).collect()
        vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.1])], "vec_id long, embedding array<float>")
        embeddings.near_duplicates(vectors).collect()
        whitening.whiten(vectors).collect()
        assert spark.conf.get(key) == "777"
    finally:
        spark.conf.set(key, before)


def test_sources_that_begin_alike_are_parted(spark):
    """Equal in their first 40 bytes: the tree splits at the source that differs behind them."""
    prefix = "https://www.example.com/a/very/long/path"
    rows = [(i, "x" * 50, "en", f"{prefix}/{i % 2}", 50) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    described = shards.numbered_values(shards.metadata(frame).drop("lang"), "source", "d_source")
    placed = shards.grow(described, ["d_source"], ["d_id", "row"], 2)
    parted = {r.node: r.sources for r in placed.groupBy("node").agg(F.collect_set("d_source").alias("sources")).collect()}
    assert sorted(map(tuple, parted.values())) == [(1,), (2,)]
    nulls = frame.withColumn("source", F.when(F.col("doc_id") % 4 > 0, F.col("source")))
    assert {r.d_source for r in shards.numbered_values(shards.metadata(nulls), "source", "d_source").collect()} == {0, 1, 2}


def test_rows_without_an_id_join_others(spark):
    a, between, b = [1.0, 0.0], [1.0, 0.4], [1.0, 0.9]
    rows = [(7, a), (None, between), (3, b), (None, [0.0, 1.0]), (None, [0.0, 1.0]), (9, [-1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = embeddings.near_duplicates(frame).collect()
    same(found, brute.near_vectors(rows))
    assert (7, 1, 3, False) in [tuple(r) for r in found] and (None, 1, None, True) in [tuple(r) for r in found]


def test_benchmark_in_parts_stores_no_texts(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    items = [(i if i % 3 else None, text(rng.randint(1, 14))) for i in range(30)]
    rows = [(i, text(rng.randint(0, 60))) for i in range(80)] + [(100, None), (None, items[0][1]), (5, items[1][1])]
    size = sum(len(t) for _, t in items)
    monkeypatch.setattr(decontaminate, "PART_BYTES", size // 5 + 1)
    stored = []
    keep = decontaminate.durable
    monkeypatch.setattr(decontaminate, "durable", lambda frame, *a: stored.append(frame.columns) or keep(frame, *a))
    found = decontaminate.find_passages(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    same(passage_rows(found), brute.passages(rows, items))
    assert len(stored) == 5 and all("text" not in columns for columns in stored)


# ---- pipeline


STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture
def toy(spark, tmp_path):
    """A folder with labels, benchmark and documents of odd kinds."""
    rng = random.Random(9)
    tables = {
        "documents": spark.createDataFrame(
            [(i, " ".join(rng.choices(["good", "fine", "plain", "words"], k=9)) + (" awful" if i % 2 else ""), None, None, 5)
             for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame(BENCHMARK, "item_id long, text string"),
    }
    for name, frame in tables.items():
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_stages_on_odd_rows(spark, odd, odd_rows, empty, toy):
    documents = odd.select("doc_id", "text", "lang", "source", "n_chars")
    ids = lambda frame: [(r.doc_id, r.text) for r in frame.collect()]
    scored = toxicity.score_texts(documents, corpus_pipeline.queries.toxicity_model(spark, toy)).collect()
    same(ids(STAGES["toxicity"](spark, odd, toy)), [(r.doc_id, r.text) for r in scored if r.score < 0.7])
    lined = STAGES["line dedup"](spark, odd, toy).collect()
    same([(r.doc_id, brute.sha(r.text or "")) for r in lined], [(r[0], r[3]) for r in brute.lines(odd_rows)])
    assert sum(r.text is None for r in lined) == sum(t is None for _, t in odd_rows)
    single = STAGES["SimHash near-dedup"](spark, odd, toy).collect()
    prints = [brute.simhash(text) for _, text in odd_rows]
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    groups = {}
    for i, root in enumerate(brute.roots(len(prints), near)):
        groups.setdefault(root, []).append(odd_rows[i])
    assert len(single) == len(groups)
    for members in groups.values():
        least = min((d for d, _ in members if d is not None), default=None)
        assert any((r.doc_id, r.text) in members and r.doc_id == least for r in single)
    clean = STAGES["benchmark decontamination"](spark, odd, toy)
    same(ids(clean), [row for row, r in zip(odd_rows, brute.passages(odd_rows, BENCHMARK), strict=True) if not r[-1]])
    encoded = STAGES["BPE encoding and decoding"](spark, odd, toy).collect()
    same([(r.doc_id, r.decoded_sha256) for r in encoded], [(d, brute.sha(t or "")) for d, t in odd_rows])
    for name, stage in STAGES.items():
        assert stage(spark, empty, toy).collect() == [], name


def test_whole_run_against_plain_versions(spark, toy, tmp_path):
    """Each stage's rows are the plain version's of the stage before, to the digests of the last."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    text = lambda n: " ".join(word() for _ in range(n))
    copies = text(40)
    rows = [(i, text(30) + "\n" + (LINE if i % 3 else text(6))) for i in range(40)]
    rows += [(100 + i, copies + (" end" if i == 2 else "")) for i in range(4)] + [(200, "c d e f g h i j k l m"), (201, "awful"), (202, None)]
    folder = str(tmp_path / "other")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{toy}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(f"{folder}/documents.parquet")
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    scored = toxicity.score_texts(documents, corpus_pipeline.queries.toxicity_model(spark, folder)).collect()
    left = [(r.doc_id, r.text) for r in scored if r.score < 0.7]
    lined = [
        (doc, None if value is None else "\n".join(kept))
        for (_, value), (doc, _, kept) in zip(left, brute.kept_lines(left), strict=True)
    ]
    kept = {r[2] for r in brute.near_texts(lined)}
    single = [row for row in lined if row[0] in kept]
    benchmark = BENCHMARK
    clean = [row for row, r in zip(single, brute.passages(single, benchmark), strict=True) if not r[-1]]
    expected = []
    for doc, value in clean:
        tokens = library.encode(value or "", add_special_tokens=False).ids
        expected.append((doc, len(tokens), brute.sha(np.array(tokens, "<u4").tobytes()), brute.sha(value or "")))
    assert 0 < len(expected) < len(rows)
    same(corpus_pipeline.run(spark, folder).collect(), expected)
