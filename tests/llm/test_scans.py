"""Passages, lines, tokens, toxicity and licences against plain versions."""

from __future__ import annotations

import random
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from staylens.llm import bpe, decontaminate, licence_texts, licences, lines, toxicity
from staylens.llm.queries import byte_vocabulary, table
from tests.llm import brute
from tests.llm.conftest import FOLDER


def same(found, expected):
    key = lambda row: tuple((v is not None, v) for v in row)
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, expected), key=key)


# ---- passages


def test_passages_of_the_benchmark(spark, documents, result):
    benchmark = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    expected = brute.passages(documents, benchmark)
    assert any(row[-1] for row in expected)
    same(result("op5_decontaminate"), expected)


BENCHMARK = [(1, "c d e f g h i j k l m"), (2, "one two"), (2, "one two"), (3, ""), (4, None), (None, "a b"),
             (50, "e"), (7, "a b c d e f g h i j"), (8, "A, B c d e f g h i j")]


def passage_rows(frame):
    return frame.select(
        "doc_id", "n_words", decontaminate.hit_words().alias("n"), F.size("hit_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256), F.size("hit_spans") > 0,
    ).collect()


@pytest.mark.parametrize("part_bytes", [1 << 20, 16])
def test_passages_in_odd_rows_and_parts(spark, odd, odd_rows, monkeypatch, part_bytes):
    monkeypatch.setattr(decontaminate, "PART_BYTES", part_bytes)
    items = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    found = decontaminate.find_passages(odd, items)
    assert "key" in found.columns and "n_chars" in found.columns
    same(passage_rows(found), brute.passages(odd_rows, BENCHMARK))


def test_passages_with_empty_tables(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_passages(empty, none).collect() == []
    assert decontaminate.find_passages(odd, none).where("size(hit_spans) > 0").collect() == []


def test_random_words_against_every_window(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    rows = [(i, text(rng.randint(0, 40))) for i in range(60)]
    items = [(i, text(rng.randint(0, 6))) for i in range(4)] + [(9, "a b a a b b a b a b"), (10, "b b a")]
    found = decontaminate.find_passages(
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"), window=4,
    )
    same(passage_rows(found), brute.passages(rows, items, 4))


# ---- lines


def test_lines_of_documents(documents, result):
    expected = brute.lines(documents)
    assert any(row[2] for row in expected)
    same(result("op6_line_dedup"), expected)


@pytest.mark.parametrize("batches", [1, 7])
def test_lines_of_odd_rows(odd, odd_rows, batches):
    kept = lines.drop_repeated_lines(odd, batches=batches)
    assert "keys" in kept.columns
    same(kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect(), brute.lines(odd_rows))


def test_lines_of_an_empty_table(empty):
    assert lines.drop_repeated_lines(empty).collect() == []


def test_runs_are_compacted_and_know_what_they_have_seen(spark):
    runs = lines.LineRuns(spark, per_level=2)
    for i in range(5):
        batch = spark.createDataFrame(
            [(bytes([k]), 1, 100 - i) for k in {0, i, i + 1}], "key binary, n_docs long, keeper long")
        fresh = {bytes(r.key) for r in runs.unseen(batch).collect()}
        assert fresh == ({b"\0", b"\1"} if i == 0 else {bytes([i + 1])})
        runs.add(batch)
    assert len(runs._runs()) == 2  # one of four batches, one of the last
    totals = {r.key[0]: (r.n_docs, r.keeper) for r in runs.totals().collect()}
    runs.drop()
    assert totals[0] == (5, 100) and totals[1] == (2, 100) and totals[5] == (1, 96)


# ---- tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def token_row(library, doc, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return doc, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(decoded)


def test_tokens_of_documents(documents, library, result):
    same(result("op7_bpe"), [token_row(library, *row) for row in documents])


def test_tokens_of_odd_rows(odd, odd_rows, empty, library):
    vocabulary = byte_vocabulary()
    same(bpe.round_trip_digests(odd, vocabulary, keep=["doc_id"]).collect(),
         [token_row(library, *row) for row in odd_rows])
    encoded = bpe.encode_texts(odd, vocabulary)
    back = bpe.decode_ids(encoded, vocabulary).select("text", "decoded").collect()
    assert all((r.text or "") == r.decoded for r in back)
    assert bpe.round_trip_digests(empty, vocabulary).collect() == []


def test_every_token_and_random_texts(library):
    vocabulary = byte_vocabulary()
    codec = bpe.Codec(vocabulary)
    ids = lambda text: np.frombuffer(codec.encode(text), "<u4").tolist()
    for token in vocabulary.tokens:
        text = token.decode("utf-8", "ignore")
        assert ids(text) == library.encode(text, add_special_tokens=False).ids
    rng = random.Random(5)
    parts = ["a", "e", "th", "in", " ", "  ", "\n", "'s", "'", "'ll", "1", "é", "ÿ", "日本", "\U0001f600", "-", "==", "er",
             "<|endoftext|>", "\x1c", "\x85", "aaaa", "²", "×", "\t", "\r\n", "ß", "."]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 40)))
        assert ids(text) == library.encode(text, add_special_tokens=False).ids, text


def test_long_runs_of_one_letter_and_of_random_letters(library):
    codec = bpe.Codec(byte_vocabulary())
    rng = random.Random(6)
    for text in ["a" * 20_000, "ab" * 9_000, "".join(rng.choices("etaoinsh", k=20_000))]:
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_broken_bytes_are_replaced_as_the_library_does(library):
    codec = bpe.Codec(byte_vocabulary())
    rng = random.Random(7)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert codec.decode(np.array(ids, "<u4").tobytes()).decode() == library.decode(ids, skip_special_tokens=False)


# ---- toxicity


def test_held_out_accuracy(spark):
    from staylens.llm.queries import QUERIES

    folder = "/root/testdata/sf0.1"
    rows = QUERIES["op9_toxicity"](spark, folder)
    labels = table(spark, folder, "labels")
    langs = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("lang_of"))
    held = [r for r in rows.join(labels, "doc_id").join(langs, "doc_id").collect() if r.held_out]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)
    by_lang = [r.predicted_by_lang for r in held if r.toxic]
    print({lang: (np.mean(own), len(own)) for lang in {r.lang_of for r in held} if (own := [
        r.predicted_by_lang for r in held if r.toxic and r.lang_of == lang])}, np.mean(by_lang))
    assert np.mean(by_lang) >= 0.9
    assert np.mean([r.predicted_by_lang for r in held if not r.toxic]) < 0.02
    right = np.mean([r.predicted == r.toxic for r in held])
    missed = np.mean([r.predicted == 0 for r in held if r.toxic])
    spoiled = np.mean([r.predicted == 1 for r in held if not r.toxic])
    assert right > 0.97 and missed < 0.15 and spoiled < 0.01, (right, missed, spoiled)


def test_scores_of_odd_rows(odd, odd_rows, empty):
    sample = [(f"text number {i} {'awful' if i % 2 else 'fine'} words".encode(), i % 2, None) for i in range(40)]
    model = toxicity.train(toxicity.Sample(sample))
    scored = toxicity.score_texts(odd, model).select("doc_id", "text", "score").collect()
    assert len(scored) == len(odd_rows) and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if not r.text}) == 1
    assert toxicity.score_texts(empty, model).collect() == []
    end = model.scores([toxicity.word_ids(b"other " * 40_000 + b"awful"), toxicity.word_ids(b"other " * 40_000)])
    assert end[0] > end[1]


def test_training_without_labels_of_a_class():
    assert toxicity.train(toxicity.Sample([])).scores([toxicity.word_ids(b"a")])[0] < 0.1
    assert toxicity.train(toxicity.Sample([(b"a b", 1, None)] * 3)).scores([toxicity.word_ids(b"a")])[0] > 0.9


def test_training_takes_every_row(spark, monkeypatch):
    """More rows of a class than one part takes, and texts of any length."""
    monkeypatch.setattr(toxicity, "PART_ROWS", 1000)
    learned = []
    added_up = toxicity._added_up

    def noted(*given):
        learned.append(added_up(*given))
        return learned[-1]

    monkeypatch.setattr(toxicity, "_added_up", noted)
    documents = spark.range(3060).selectExpr(
        "id doc_id", "concat('plain words ', id, if(id >= 3000, repeat(' other', 14000) || ' awful', '')) text", "'en' lang")
    labels = documents.selectExpr("doc_id", "int(doc_id >= 3000) toxic")
    model = toxicity.train_on(documents, labels)
    held = documents.selectExpr("doc_id >= 3000 toxic", "pmod(xxhash64(doc_id, text), 5) = 0 held").where("held")
    left = {r.toxic: n - r["count"] for r in held.groupBy("toxic").count().collect() for n in [60 if r.toxic else 3000]}
    # Three parts; every row of the smaller class is in each of them.
    assert {total[0] for total in learned} == {left[False] + 3 * left[True]}
    assert len(learned) >= toxicity.EPOCHS
    calm, awful = model.scores([toxicity.word_ids(b"plain words 7" + end) for end in (b"", b" other" * 14000 + b" awful")])
    assert calm < awful


def test_training_on_tables_without_a_class(spark, empty):
    labels = empty.selectExpr("doc_id", "1 toxic")
    assert toxicity.train_on(empty, labels).scores([toxicity.word_ids(b"a")])[0] < 0.1
    documents = spark.createDataFrame([(1, "a b", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = toxicity.train_on(documents, documents.selectExpr("doc_id", "1 toxic"))
    assert model.scores([toxicity.word_ids(b"a")])[0] > 0.9


def test_scores_do_not_depend_on_the_batch():
    rng = random.Random(8)
    model = toxicity.TextCnn.start(1)
    texts = [toxicity.word_ids(" ".join(rng.choices("abcdef", k=rng.choice([0, 1, 3, 50, 40_000]))).encode())
             for _ in range(30)]
    together = model.scores(texts)
    alone = [model.scores([t])[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)


# ---- licences


def test_names_of_licences_in_documents(documents, result):
    expected = brute.licences(documents, licence_texts.NAMES)
    assert any(row[2] for row in expected)
    same([r[:6] for r in result("op10_licences")], expected)


def test_licences_of_odd_rows(odd, odd_rows, empty):
    scan = lambda frame: licences.scan_licences(frame, licence_texts.NAMES, licence_texts.NOTICES)
    found = scan(odd).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "score")
    same([r[:6] for r in found.collect()], brute.licences(odd_rows, licence_texts.NAMES))
    assert all(0 <= r.score <= 1 for r in found.collect())
    assert scan(empty).collect() == []


def test_matching_statistics_and_names_on_random_words():
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    names = {"x": "a b", "y": "b", "z": "a b a", "w": "c c a b"}
    automaton = licences.NoticeAutomaton(names, {f"n{i}": text(12) for i in range(4)})
    rows = [(i, text(rng.randint(0, 60)).replace("c c c", "q")) for i in range(300)]
    for (_, t), expected in zip(rows, brute.licences(rows, names), strict=True):
        places = [p for p, _ in automaton.scan([w.encode() for w in t.split()])[0]]
        assert (len(places), min(places, default=None), max(places, default=None)) == expected[2:5]


def test_a_notice_with_small_changes_is_covered(spark):
    notice = licence_texts.NOTICES["bsd"][0]
    changed = notice.replace("the above copyright", "this copyright").replace("binary forms", "binary form")
    rows = [(1, "before " * 50 + changed + " after"), (2, notice[:80]), (3, "the software is in use and the code")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in licences.scan_licences(frame, licence_texts.NAMES, licence_texts.NOTICES).collect()}
    assert found[1].labels == "bsd" and found[1].score > 0.8
    assert found[2].labels == "" and found[3].labels == ""


def test_whole_licences_are_found_in_long_texts(spark):
    """Each licence's texts, one word in thirty changed, between other words: its label and none of another family."""
    rng = random.Random(11)
    rows, expected = [], {}
    for label, own in licence_texts.NOTICES.items():
        for text in (own,) if isinstance(own, str) else own:
            changed = text.split()
            for i in range(len(changed) // 2, len(changed), 30):
                changed[i] = "changed" if len(changed) > 30 else changed[i]
            around = [" ".join(rng.choices(["int", "return", "value"], k=300)) for _ in range(2)]
            expected[len(rows)] = label
            rows.append((len(rows), f"{around[0]} Copyright 2020 {' '.join(changed)} {around[1]}"))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = licences.scan_licences(frame, licence_texts.NAMES, licence_texts.NOTICES).collect()
    assert all(expected[r.doc_id] in r.labels.split(",") for r in found)
    # Notices of one family share most of their words, so each may cover the others.
    families = [{"agpl", "gpl", "lgpl"}, {"cc-by", "cc-by-sa", "cc-by-nc"}]
    for r in found:
        own = {expected[r.doc_id]}.union(*[f for f in families if expected[r.doc_id] in f])
        assert set(r.labels.split(",")) <= own, r
    assert all(0.6 <= r.score <= 1 for r in found)


def test_part_of_a_name_is_no_label():
    automaton = licences.NoticeAutomaton(licence_texts.NAMES, licence_texts.NOTICES)
    scan = lambda text: automaton.scan(text.lower().encode().split())
    for text in ("under the GNU Library General Public License here", "the GNU General Public terms",
                 "some General Public License of a vendor"):
        names, shares, score = scan(text)
        assert names == [] and shares == {} and score < licences.MIN_COVER, text
    names, _, score = scan("under the GNU General Public License here")
    assert [label for _, label in names] == ["gpl"] and score == 1.0


def test_matches_are_chained_at_every_place_of_every_notice():
    one = "a b c d " + " ".join(f"m{i}" for i in range(14)) + " a b c d n1 n2 n3 n4"
    notices = {"one": one, "two": "p q r s t u v w", "three": "x q r s t u v y z k"}
    automaton = licences.NoticeAutomaton({}, notices)
    scan = lambda text: automaton.scan(text.encode().split())[1]
    # The second place of a run; the part of a match that another notice holds.
    tail = " ".join(f"m{i}" for i in range(4, 14)) + " changed a b c d other n1 n2 n3 n4"
    assert scan(tail) == {"one": 18 / 26}
    assert scan("p q r s t u v w") == {"two": 1.0, "three": 0.6}


def test_every_maximal_match_against_every_pair_of_places(monkeypatch):
    rng = random.Random(10)
    text = lambda n: [rng.choice("abc") for _ in range(n)]
    notices = [text(12) for _ in range(4)]
    automaton = licences.NoticeAutomaton({"x": "a b a c"}, {str(i): " ".join(n) for i, n in enumerate(notices)})
    seen = set()
    monkeypatch.setattr(automaton, "_chain", lambda *args: seen.add(args[2:6]))
    for _ in range(100):
        found, expected = text(rng.randint(0, 40)), set()
        seen.clear()
        automaton.scan([w.encode() for w in found])
        for k, notice in enumerate(notices):
            for e in range(1, len(notice) + 1):
                for t in range(1, len(found) + 1):
                    size = 0
                    while size < min(e, t) and notice[e - 1 - size] == found[t - 1 - size]:
                        size += 1
                    if size >= licences.MIN_MATCH and (e == len(notice) or t == len(found) or notice[e] != found[t]):
                        expected.add((k, e, t, size))
        assert seen == expected
