"""Shards, near duplicates, repeated passages, secrets and the pipeline against plain versions."""

from __future__ import annotations

import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from staylens.llm import embeddings, passages, secrets, shards, simhash
from staylens.llm.components import components
from staylens.llm.queries import QUERIES, table
from tests.llm import brute
from tests.llm.conftest import COLUMNS, FOLDER
from tests.llm.test_scans import same

# ---- shards


def check_shards(rows, documents, count, largest_share=True):
    expected = Counter((doc, len((t or "").encode()) + 16, crc32((t or "").encode())) for doc, t in documents)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    sizes, slots = Counter(), {}
    for r in rows:
        assert 0 <= r.shard < count
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_shards_are_near_equal(documents, result):
    rows = result("op1_kd_shards")
    sizes = check_shards(rows, documents, 40)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    mean = sum(sizes.values()) / 40
    largest = max(r.size for r in rows)
    assert all(abs(sizes[s] - mean) <= largest for s in range(40))


def test_shards_of_odd_rows(odd, odd_rows, empty):
    check_shards(shards.shard(odd, 5).collect(), odd_rows, 5)
    assert shards.shard(empty).collect() == []
    few = shards.shard(odd, target_bytes=100_000).collect()
    assert max(r.shard for r in few) < 5


def test_equal_rows_are_parted(spark):
    frame = spark.createDataFrame([(7, "same", None, None, 4)] * 1000, "doc_id long, text string, lang string, source string, n_chars long")
    sizes = check_shards(shards.shard(frame, 8).collect(), [(7, "same")] * 1000, 8)
    assert max(sizes.values()) - min(sizes.values()) <= 40


def test_many_shards_bring_no_nodes_to_the_driver(spark, monkeypatch):
    """5,000 leaves: no collect while the tree grows has more than a row."""
    docs = spark.range(20_000).selectExpr(
        "id * 7919 % 20011 as doc_id", "repeat('x', cast(id % 37 as int)) as text",
        "cast(id % 3 as string) as lang", "cast(id % 5 as string) as source", "id as n_chars",
    )
    total = docs.selectExpr("sum(octet_length(text) + 16) as b").first().b
    seen = []
    collect = type(docs).collect

    def counted(frame):
        rows = collect(frame)
        seen.append(len(rows))
        return rows

    monkeypatch.setattr(type(docs), "collect", counted)
    result = shards.shard(docs, target_bytes=total // 5000 + 1)
    assert max(seen) <= 1
    monkeypatch.undo()
    sizes = result.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()
    assert max(r.shard for r in sizes) in range(4900, 5000)
    assert max(r.bytes for r in sizes) <= total / 5000 + 2 * (36 + 16)
    assert result.count() == 20_000


# ---- components


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    edges += [(1000 + i, 1001 + i) for i in range(200)] + [(2000, 2001 + i) for i in range(200)] + [(5, 5)]
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.root for r in components(frame).collect()}
    linked = sorted({n for e in edges if e[0] != e[1] for n in e})
    places = {n: i for i, n in enumerate(linked)}
    expected = brute.roots(len(linked), [(places[a], places[b]) for a, b in edges if a != b])
    assert found == {n: linked[expected[i]] for n, i in places.items()}


# ---- SimHash


def test_near_texts_of_documents(documents, result):
    expected = brute.near_texts(documents)
    assert any(row[0] != row[2] for row in expected)
    same(result("op2_simhash"), expected)


def test_near_texts_of_odd_rows(odd, odd_rows, empty):
    found = simhash.near_duplicates(odd)
    assert "score" in found.columns
    same(found.select("doc_id", simhash.hex_digits(), "component_id").collect(), brute.near_texts(odd_rows))
    kept = simhash.one_of_each(found).collect()
    assert sorted(Counter(r.component_root for r in kept).values()) == [1] * len({r.component_root for r in found.collect()})
    assert simhash.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("block", [2048, 3])
@pytest.mark.parametrize("segments", [1, 2, 3, 5])
def test_links_join_all_near_fingerprints(spark, monkeypatch, block, segments):
    if segments != 2 and block == 3:
        pytest.skip("blocks are tested with two segments")
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(2)
    bits = 3 if segments > 1 else 2
    centres = [rng.getrandbits(64) for _ in range(4)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(12)}
    values = sorted(values | {rng.getrandbits(64) for _ in range(20)} | {0, 1, 1 << 63, (1 << 64) - 1})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = simhash.links(frame, segments, bits).collect()
    place = {v: i for i, v in enumerate(signed)}
    near = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= bits]
    pairs = [(place[r.a], place[r.b]) for r in found]
    assert all((values[i] ^ values[j]).bit_count() <= 3 * bits for i, j in pairs)
    assert brute.roots(len(values), pairs) == brute.roots(len(values), near)


# ---- passages


def test_passages_removed_from_documents(documents, result):
    expected = brute.passages_removed(documents)
    assert any(0 < row[2] < row[1] for row in expected)
    found = result("op3_passage_dedup")
    same([r[:5] for r in found], expected)
    assert all(r.repeats == (r.n_removed > 0) for r in found)


@pytest.mark.parametrize("group", [30_000, 1])
def test_passages_removed_from_odd_rows(odd, odd_rows, empty, monkeypatch, group):
    monkeypatch.setattr(passages, "GROUP_PIECES", group)
    found = passages.drop_passages(odd, length=16, gram=4)
    assert "ids" in found.columns
    same(found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect(),
         brute.passages_removed(odd_rows, 16))
    assert passages.drop_passages(empty).collect() == []


def sharing_words(rows, n):
    """For each row, whether it has ``n`` words in a row which a row of other or equal text has too."""
    runs = []
    for _, text in rows:
        words = (text or "").encode().split()
        runs.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)})
    seen = Counter(run for own in runs for run in own)
    return [any(seen[run] > 1 for run in own) for own in runs]


def test_short_passages_of_over_fifty_words_are_told(spark, documents, result):
    expected = dict(zip([d for d, _ in documents], sharing_words(documents, 51), strict=True))
    found = result("op3_passage_dedup")
    assert {r.doc_id: r.shares_words for r in found} == expected
    # Some hold no string of 400 bytes that repeats, so they lose nothing.
    assert any(r.shares_words and not r.n_removed for r in found)

    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(3, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(51)
    rows = [(i, f"{text(40)} {passage}\n{text(i)}") for i in range(3)]
    rows += [(3, f"{text(9)} {passage.rsplit(' ', 1)[0]} {text(9)}"), (4, f"{passage} x " + passage.replace(" ", "\t "))]
    alone = text(60)
    rows += [(5, f"{alone} and {alone}"), (6, text(300)), (7, None), (8, "")]
    frame = spark.createDataFrame([(*r, None, None, None) for r in rows], COLUMNS)
    told = passages.drop_passages(frame, keep=["doc_id"], n_words=51).collect()
    assert {r.doc_id: r.shares_words for r in told} == {i: i in (0, 1, 2, 4) for i in range(9)}
    assert all(r.n_removed == 0 for r in told if r.doc_id < 4)


@pytest.mark.parametrize("group", [30_000, 1])
@pytest.mark.parametrize("n", [1, 2, 3, 12])
def test_shared_words_of_odd_rows(odd, odd_rows, empty, monkeypatch, group, n):
    monkeypatch.setattr(passages, "GROUP_PIECES", group)
    found = passages.drop_passages(odd, keep=["doc_id", "text"], n_words=n)
    same(found.select("doc_id", "text", "shares_words").collect(),
         [(*row, shares) for row, shares in zip(odd_rows, sharing_words(odd_rows, n), strict=True)])
    assert passages.drop_passages(empty, n_words=n).collect() == []


def test_words_of_parts_of_a_text_agree(monkeypatch):
    monkeypatch.setattr(passages, "STEP", 64)
    rng = random.Random(2)
    hashes, seen = passages.WordHashes(), {}
    for _ in range(150):
        text = bytes(rng.choices(b"ab\xc3\xa9 \n\t\x0b\x1c", k=rng.randint(0, 300))) + b"c" * rng.choice([0, 0, 500])
        found = hashes.of(text).tolist()
        assert len(found) == len(text.split())
        assert all(seen.setdefault(word, h) == h for word, h in zip(text.split(), found, strict=True))
    assert len(set(seen.values())) == len(seen) > 500


def test_anchors_of_parts_of_a_text_agree(monkeypatch):
    monkeypatch.setattr(passages, "STEP", 64)
    rng = random.Random(1)
    anchors, seen = passages.Anchors(20, 4), {}
    for _ in range(150):
        text = bytes(rng.choices(b"abc", k=rng.randint(0, 300)))
        covered = []
        for gram, anchor, first, last in zip(*anchors.of(text), strict=True):
            for start in range(first, last + 1):
                covered.append(start)
                own = (int(gram), int(anchor) - start)
                assert seen.setdefault(text[start : start + 20], own) == own
        assert covered == list(range(max(0, len(text) - 19)))
    text = bytes(rng.choices(b"abcdefgh", k=3000))
    assert len(passages.Anchors(100, 8).of(text)[0]) < 150


# ---- embeddings


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_near_vectors_of_the_table(spark, result):
    rows = [(r.vec_id, r.embedding) for r in table(spark, FOLDER, "embeddings").collect()]
    same(result("op4_embedding_dedup"), brute.near_vectors(rows))


@pytest.mark.parametrize("tile", [8192, 4])
def test_near_vectors_of_clusters_and_odd_rows(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE_ROWS", tile)
    rng = np.random.default_rng(4)
    rows = []
    for centre in rng.normal(size=(6, 12)):
        rows += [(len(rows) + i, (centre + rng.normal(size=12) * 0.25).tolist()) for i in range(10)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 12, [nan] + [1.0] * 11, [inf] + [1.0] * 11, [None] + [1.0] * 11, [1.0, 2.0], [2.0, 4.0],
           [1e38] * 12, [1e-38] * 12, [-0.0] + [1.0] * 11, [0.0] + [1.0] * 11, rows[0][1], rows[0][1], rows[3][1]]
    rows += [(1000 + i, v) for i, v in enumerate(odd)] + [(None, rows[0][1]), (None, None), (3, rows[3][1])]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    found = embeddings.near_duplicates(vectors(spark, [(*r, None) for r in rows])).collect()
    # Ids that repeat are told apart by their vectors only, so both rows must be equal here.
    same(found, brute.near_vectors(rows))


def test_no_vectors(spark):
    assert embeddings.near_duplicates(vectors(spark, [])).collect() == []


def test_quantised_products_miss_nothing():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 64))
    a = np.concatenate([base, base + rng.normal(size=base.shape) * 0.45])
    stats = {}
    found = {tuple(p) for p in embeddings.near_pairs(a, a, 0.9, stats).tolist()}
    unit = a / np.linalg.norm(a, axis=1, keepdims=True)
    assert found == {tuple(p) for p in np.argwhere(unit @ unit.T >= 0.9).tolist()}
    assert len(found) <= stats["recomputed"] < 0.1 * len(a) ** 2


# ---- secrets


def test_secrets_found_and_false_positives_removed(spark):
    rng = random.Random(6)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n - 1)) + "7"
    rows, planted = [], set()
    for i in range(120):
        key = "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=15)) + "2"
        password, token = hexes(18), hexes(40)
        planted |= {key, password, token}
        rows.append((i, f'words {key} and password={password} then\ntoken = "{token}" card {rng.randrange(10**15, 10**16)}'
                        f" see http://a.example.com/{hexes(20)} or /usr/lib/{hexes(14)}/x"))
    frame = spark.createDataFrame([*rows, (None, None), (500, ""), (501, rows[0][1])], "doc_id long, text string")
    words = spark.createDataFrame([("words",), ("library",)], "word string")
    found = secrets.scan_secrets(frame, words, F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True))).collect()
    expected = {brute.sha(p) for p in planted}
    held_out = [r for r in found if r.doc_id % 2]
    assert {r.finding_sha256 for r in found if r.is_secret} == expected
    assert len(found) == 121 * 6 and all(r.is_secret == (r.finding_sha256 in expected) for r in held_out)
    none = secrets.scan_secrets(frame.where("doc_id is null"), words, F.lit(True))
    assert none.collect() == []


def candidates(spark, text):
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    none = spark.createDataFrame([], "word string")
    return [r.candidate for r in secrets.findings(frame, none).orderBy("place").collect()]


def test_secrets_without_digits_and_beside_signs_are_candidates(spark):
    key, token = "AKIA" + "ABCDEFGHIJKLMNOP", "ghp_" + "aBcDeFgHiJkL" * 3
    assert candidates(spark, f"{key} s3/{key}/ key-{key}, id_{token}-x {token}a") == [key, key, key, token]
    assert candidates(spark, f"see 0123456789abc/{key}/0123456789def {key}-abcdef") == [
        "0123456789abc/", key, "/0123456789def", key]
    values = "password=CorrectHorseBattery. \"api_key\": \"QwErTyUiOp\", secret: a.b!c; Token = 'x'"
    assert candidates(spark, values) == ["CorrectHorseBattery", "QwErTyUiOp", "a.b!c", "x"]
    assert candidates(spark, f"password=tmp-{key}") == ["tmp-", key]
    assert candidates(spark, "Author: Somebody, tokens of words and aPlainLongWordOfLetters auth://host") == []
    long = "Ab1/" * 50_000
    assert candidates(spark, f"{long} password={long}\U0001f600{long}") == [long, f"{long}\U0001f600{long}"]


def test_digitless_and_adjacent_secrets_are_found(spark):
    rng = random.Random(7)
    letters = lambda n: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=n))
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n - 1)) + "7"
    rows, planted = [], set()
    for i in range(120):
        key, other = "AKIA" + letters(16), "AKIA" + letters(16)
        password = letters(9).title() + letters(9).title()
        planted |= {key, other, password}
        rows.append((i, f"words {key} at s3/{other}/ and password={password} then\ncard {rng.randrange(10**15, 10**16)}"
                        f" see http://a.example.com/{hexes(20)} or /usr/lib/{hexes(14)}/x"))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    words = spark.createDataFrame([("words",)], "word string")
    found = secrets.scan_secrets(frame, words, F.col("doc_id") % 2 == 0).collect()
    assert len(found) == 120 * 6
    assert {r.finding_sha256 for r in found if r.is_secret} == {brute.sha(p) for p in planted}


def hard_findings(rng, n):
    """Findings whose truth the rules do not know: keys without a name, and ids that look like them."""
    mixed = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789"
    rows, truth = [], {}
    for i in range(n):
        key = "".join(rng.choices(mixed, k=32))
        key = key if any(c.isdigit() for c in key) else key[:-1] + "7"
        uid = "-".join("".join(rng.choices("0123456789abcdef", k=k)) for k in (8, 4, 4, 4, 12))
        build = f"build-{rng.randrange(10**6)}-{''.join(rng.choices('0123456789', k=8))}"
        truth |= {key: 1, uid: 0, build: 0}
        rows.append((i, f"send {key} with it\nrequest {uid} came from {build} today"))
    return rows, truth


def test_judged_findings_are_learned_from(spark):
    """Known truth of findings that no rule decides: precision and recall on documents not learned from."""
    rows, truth = hard_findings(random.Random(12), 240)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "word string")
    undecided = secrets.findings(frame, none).where(secrets.rule_label().isNotNull())
    assert undecided.count() == 0
    judged = [(brute.sha(c), label) for c, label in truth.items()] + [(brute.sha("x"), 1), (brute.sha("x"), 0), (None, None)]
    labelled = spark.createDataFrame(judged, "finding_sha256 string, label int")
    found = secrets.scan_secrets(frame, none, F.col("doc_id") % 3 != 1, labelled=labelled).collect()
    held_out = [r for r in found if r.doc_id % 3 == 1]
    known = {brute.sha(c): label for c, label in truth.items()}
    assert len(held_out) == 80 * 3
    right = sum(r.is_secret and known[r.finding_sha256] for r in held_out)
    assert right / sum(r.is_secret for r in held_out) >= 0.95
    assert right / 80 >= 0.95


def test_contexts_reach_over_other_candidates(spark):
    texts = [
        'oauth2_client_secret=0a1b2c3d4e5f6 then AWS_S3_SECRET_ACCESS_KEY: 1a1b2c3d4e5f6',
        'client_secret_v2 = "2a1b2c3d4e5f6" and order_2024_0001 3a1b2c3d4e5f6 checksum_sha256',
        "\U0001f600é " * 30 + "pwd=a pwd=b token:c " * 40 + "0123456789ab " * 30,
        "pwd=a", "", None,
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = secrets.findings(frame, spark.createDataFrame([], "word string")).orderBy("doc_id", "place").collect()
    at = dict.fromkeys(range(len(texts)), 0)
    for r in rows:
        start = texts[r.doc_id].index(r.candidate, at[r.doc_id])
        start = start if len(r.candidate) > 1 else next(
            i for i in range(start, 10**6) if texts[r.doc_id][i] == r.candidate and texts[r.doc_id][i - 1] in "=:")
        at[r.doc_id] = end = start + len(r.candidate)
        assert r.before == texts[r.doc_id][max(0, start - 48) : start]
        assert r.after == texts[r.doc_id][end : end + 24]
    assert Counter(r.doc_id for r in rows) == {0: 4, 1: 5, 2: 150, 3: 1}
    named = {r.candidate: r for r in rows}
    for digit in "012":
        r = named[f"{digit}a1b2c3d4e5f6"]
        assert r.assigned == r.credential_near == 1
    assert named["3a1b2c3d4e5f6"].other_near == 1
    labels = secrets.findings(frame, spark.createDataFrame([], "word string")).withColumn("label", secrets.rule_label())
    assert {r.candidate for r in labels.where("label = 1 and doc_id < 2").collect()} == {
        f"{digit}a1b2c3d4e5f6" for digit in "012"}


def test_secret_queries_use_no_python(spark):
    plan = QUERIES["op8_secrets"](spark, FOLDER)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


# ---- pipeline


def test_pipeline_stages(spark, monkeypatch):
    documents = table(spark, FOLDER, "documents")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination",
                            "BPE encoding and decoding"]
    scored = {r.doc_id: r.predicted for r in QUERIES["op9_toxicity"](spark, FOLDER).collect()}
    kept = stages["toxicity"](spark, documents, FOLDER)
    same(kept.select("doc_id", "text").collect(), [r for r in rows if not scored[r[0]]])
    lined = stages["line dedup"](spark, documents, FOLDER)
    assert lined.columns == documents.columns
    same([(r.doc_id, brute.sha(r.text)) for r in lined.collect()], [(r[0], r[3]) for r in brute.lines(rows)])
    single = stages["SimHash near-dedup"](spark, documents, FOLDER)
    same(single.select("doc_id").collect(), {(r[2],) for r in brute.near_texts(rows)})
    clean = stages["benchmark decontamination"](spark, documents, FOLDER)
    benchmark = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    same(clean.select("doc_id").collect(), [(r[0],) for r in brute.passages(rows, benchmark) if not r[-1]])
    whole = corpus_pipeline.run(spark, FOLDER)
    assert 0 < whole.count() < len(rows)
    assert whole.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
