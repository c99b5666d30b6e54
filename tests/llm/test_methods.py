"""Models, batteries and bounds of the text operators against plain versions, and odd rows in the stages."""

import collections
import random
import time
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracklake.llm import classifier, decontaminate, lengths, lines, pieces, rules, secrets, simhash
from tracklake.llm.common import KEY, clear, keyed_texts, read, staged
from tracklake.plans import staging


def test_rules_equal_plain_expectation_maximisation(spark, sf_dir):
    frame = rules.judge(read(spark, sf_dir, "documents")).cache()
    names = list(rules.rules())
    rows = frame.groupBy(*names).agg(F.count("*").alias("n"), F.min("p_good").alias("low"), F.max("p_good").alias("high")).collect()
    want = brute.posterior([({n: r[n] for n in names}, r.n) for r in rows], rules.KINDS, rules.prior)
    assert all(abs(r.low - p) < 1e-3 and abs(r.high - p) < 1e-3 for r, p in zip(rows, want, strict=True))
    assert all(r.kept == (not r.base_failed and r.p_good >= 0.5) for r in frame.collect())


def test_rules_keep_good_documents_with_one_complaint(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    complaints = sum((F.when(F.col(n) == 0, 1).otherwise(0) for n in rules.rules()), F.lit(0))
    frame = rules.judge(read(spark, folder, "documents")).where("NOT base_failed").withColumn("complaints", complaints).join(read(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left")
    n = collections.Counter((min(r.complaints, 2), r.kept, r.quality) for r in frame.collect())
    assert n[1, True, 1] > 5 and n[1, True, 0] == 0 and n[2, True, 0] == 0 and n[0, False, 1] == n[1, False, 1] == 0


def test_random_spans_equal_brute_force(spark):
    rng, docs = random.Random(9), []
    words = ["".join(rng.choice(("ba", "ne", "ri", "to", "su", "la")) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    for i in range(150):
        text = " ".join(rng.choice(words) for _ in range(60)) + " " + "_".join(rng.choice(words) for _ in range(rng.randint(3, 14)))
        if i % 3 == 0:
            letters = secrets.ENCODINGS[rng.randrange(len(secrets.ENCODINGS))][1]
            text += " key=" + "".join(rng.choice(letters) for _ in range(rng.choice((16, 20, 32, 64, 140)))) + rng.choice(("", "==")) + " end"
        if i % 10 == 0:
            text += " password: hunter2222 " + "AKIA" + "Q" * 16
        docs.append((i, text))
    docs += [(200, None), (201, ""), (202, docs[0][1]), (None, docs[3][1])]
    rows = secrets.scan_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = [(r.doc_id, *map(int, x.split(":")[1:])) for r in rows for x in r.spans.split(",") if x.startswith("random")]
    want = brute.random_tokens(docs, secrets._EXPECTED)
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 30
    again = {r.doc_id: r.spans for r in rows}
    assert again[202] == again[0] and again[None] == again[3] and again[200] == again[201] == ""


def test_random_tokens_are_found_in_every_encoding(spark, sf_dir):
    texts = read(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents").select("text")
    model, rng = secrets.text_model(secrets.pair_counts(texts)), random.Random(1)
    for name, letters in secrets.ENCODINGS[1:]:
        for n, least in ((16, 45), (20, 70), (24, 80), (32, 95), (64, 95)):  # a lone token, so a strict p; see the README
            found = sum(secrets.p_text("".join(rng.choice(letters) for _ in range(n)), model) < 1e-5 for _ in range(100))
            assert found >= least, (name, n, found)
    for word in ("src/main/java/com/example/service", "TheQuickBrownFoxJumpsOverTheLazyDog", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "configuration_value_of_the_server", "12345678901234567890123456"):
        assert secrets.p_text(word, model) > 1e-5


def _sparse_rows(docs, p):
    data = [np.frombuffer(t.encode(), np.uint8) for _, t in docs]
    at = np.concatenate(([0], np.cumsum([len(x) for x in data])))
    return [dict(zip(s.tolist(), v.tolist(), strict=True)) for s, v in classifier._sparse(np.concatenate(data), at, p.bits)]


def test_classifier_equals_plain_updates(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(("good", "fine", "Text", "a", "b") if i % 2 else ("BUY!!", "now", "$$", "a")) for _ in range(30))) for i in range(60)]
    marks, p = [(i, i % 2) for i in range(0, 60, 2)] + [(i, 1) for i in range(1, 60, 2)], classifier.Ftrl(bits=12, shards=1, epochs=2)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    weights = classifier.train(frame, spark.createDataFrame(marks, "doc_id long, quality int"), p)
    labels = dict(marks)
    used = sorted(((t, labels[d]) for d, t in docs if zlib.crc32(str(d).encode()) % 3 != 1))
    want = brute.ftrl(list(zip(_sparse_rows([(0, t) for t, _ in used], p), [y for _, y in used], strict=True)), p)
    assert np.allclose([weights[i] for i in sorted(want)], [want[i] for i in sorted(want)], atol=1e-9) and np.count_nonzero(weights) <= len(want)
    p = classifier.Ftrl(bits=12, shards=50, epochs=2)
    weights = classifier.train(frame, spark.createDataFrame(marks, "doc_id long, quality int"), p)
    shards = collections.defaultdict(list)
    for r in keyed_texts(frame).withColumn("shard", F.pmod(KEY, F.lit(p.shards))).collect():
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            shards[r.shard].append((r.text, labels[r.doc_id]))
    assert len(shards) < p.shards  # those without rows do not shrink the mean
    want = collections.defaultdict(float)
    for rows in shards.values():
        rows.sort()
        for slot, w in brute.ftrl(list(zip(_sparse_rows([(0, t) for t, _ in rows], p), [y for _, y in rows], strict=True)), p).items():
            want[slot] += w / len(shards)
    assert np.allclose([weights[i] for i in sorted(want)], [want[i] for i in sorted(want)], atol=1e-9)


def test_benchmark_patterns_hold_tens_of_bytes_for_each_word():
    rng = np.random.default_rng(0)
    items = [(str(i), " ".join(f"w{x}" for x in rng.integers(0, 50_000, 500))) for i in range(300)]
    size, n = sum(len(t) for _, t in items), 150_000
    held = decontaminate.Patterns(items, 10)
    assert held.held_bytes() < 60 * n and held.held_bytes() < 12 * size
    table = held.tables[0][0]
    assert (table.shift == 0).mean() < 0.15  # most blocks of words shift further


def test_token_lengths_of_odd_rows(spark, odd_docs, odd_frame):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encode = lengths._encoding(path, public_tokenizers.PATTERN).encode_ordinary
    frame = odd_frame.unionByName(odd_frame.where("doc_id IN (1, 4)")).unionByName(odd_frame.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    rows = odd_docs + [r for r in odd_docs if r[0] in (1, 4)] + [(None, odd_docs[4][1])]
    got = lengths.token_lengths(frame, path, public_tokenizers.PATTERN)
    assert sorted(map(str, got.collect())) == sorted(f"Row(doc_id={d}, n_tokens={len(encode(t or ''))})" for d, t in rows)
    assert lengths.token_lengths(frame.where("false"), path, public_tokenizers.PATTERN).count() == 0
    n = sorted(len(encode(t or "")) for _, t in rows)
    assert [tuple(r) for r in lengths.length_histogram(got).select("n_tokens", "n_docs").orderBy("n_tokens").collect()] == [(x, n.count(x)) for x in sorted(set(n))]


CLASHING = "tl_row_key gone gone_key row lines tl_key tl_keep tl_gone wins inner hashes full start size h body doc fp u v hits items hit_key n component_id score label_doc quality slot tl_slot".split()


@pytest.fixture(scope="module")
def stage_rows(spark):
    rng = random.Random(11)
    words = ["term%d" % i for i in range(200)]
    passage = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(6)]
    own = lambda: "\n".join(" ".join(rng.choice(words) for _ in range(10)) for _ in range(6))
    base = own()
    rows = [(1, None), (2, ""), (3, " \n "), (4, base), (5, base), (5, base), (6, base + " tail"), (7, own() + "\n" + "\n".join(passage)), (8, "\n".join(passage) + "\n" + own()), (9, " ".join(rng.choice(words) for _ in range(40_000))), (None, own()), (None, base), (10, own() + "\nitem one two three four five six seven eight nine ten\n" + own())]
    rows = [(d, t, "en", "s", None if t is None else len(t), *[f"{c}{i}" for c in CLASHING]) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING))


@pytest.fixture(scope="module")
def stage_tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(4, 1), (6, 0), (None, 1), (5, None), (4, 1)], "doc_id long, quality int").write.parquet(folder + "/labels.parquet")
    spark.createDataFrame([(1, "Item one two three four five six seven eight nine TEN"), (2, None), (None, "")], "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
    return folder


def _whole(rows):
    return collections.Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_on_odd_rows_and_clashing_names(spark, stage_rows, stage_tables, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = staged(stage(spark, stage_rows, stage_tables), "odd")
    assert out.columns == stage_rows.columns
    rows, before = out.collect(), stage_rows.collect()
    if name != "line_dedup":
        assert _whole(rows) <= _whole(before)
    else:
        names = [c for c in out.columns if c not in ("text", "n_chars")]
        assert collections.Counter(tuple(r[c] for c in names) for r in rows) <= collections.Counter(tuple(r[c] for c in names) for r in before)
        texts = {}
        for d, t in sorted((r.doc_id, r.text or "") for r in before if r.doc_id is not None):
            texts[d] = t
        whole = {r.doc_id: r.kept_text for r in lines.dedup_lines(stage_rows).collect() if r.doc_id is not None}
        assert {r.doc_id: r.text or "" for r in rows if r.doc_id is not None} == {d: t for d, t in whole.items() if t.strip() or not texts[d].strip()}
        assert sum(r.doc_id is None for r in rows) == 2 and 5 not in {r.doc_id for r in rows} and all(r.n_chars is None or r.n_chars == len(r.text) for r in rows)
    if name == "simhash_near_dedup":
        roots = {r.doc_id: r.component_id for r in simhash.near_duplicates(stage_rows).collect()}
        kept = [r.doc_id for r in rows if r.doc_id is not None]
        assert sorted(kept) == sorted({c for d, c in roots.items() if d is not None}) and 1 in kept and 2 not in kept
    if name == "benchmark_decontamination":
        assert _whole(rows) == _whole(r for r in before if r.doc_id != 10)
        several = decontaminate.decontaminate(stage_rows, read(spark, stage_tables, "benchmark"), block_bytes=10)
        assert _whole(several.collect()) == _whole(rows)
    if name == "quality_classifier":
        scores = classifier.score(stage_rows, classifier.train(stage_rows, read(spark, stage_tables, "labels")))
        assert len(rows) == scores.where("score >= 0.5").count()
    assert stage(spark, stage_rows.where("false"), stage_tables).count() == 0


def test_last_stage_on_odd_rows(spark, stage_rows, stage_tables):
    out = corpus_pipeline.piece_encoding(spark, stage_rows, stage_tables)
    assert out.count() == stage_rows.count() and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert corpus_pipeline.piece_encoding(spark, stage_rows.where("false"), stage_tables).count() == 0


def test_staged_tables_can_be_cleared(spark):
    table = staged(spark.range(5), "numbers")
    assert table.count() == 5
    clear(spark)
    assert not staging._written[spark.sparkContext.applicationId]



def test_secrets_of_a_text_with_very_many_spans(spark):
    rng = random.Random(5)
    digests = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(100_000)]
    began = time.time()
    row = secrets.scan_secrets(spark.createDataFrame([(1, " ".join(digests))], "doc_id long, text string")).first()
    assert row.n_hex == 100_000 and row.n_random == 0 and time.time() - began < 60
    free = secrets._clear_of([(10, 0, 20), (12, 1, 50), (70, 2, 80)])
    spans = [(10, 20), (12, 50), (70, 80)]
    assert all(free(a, b) == (not any(s < b and a < e for s, e in spans)) for a in range(100) for b in range(a + 1, 101))


def test_pieces_of_a_long_text_without_spaces(spark):
    import sentencepiece

    rng = random.Random(6)
    text = "".join(rng.choice(("ab", "tion", "é", "日", "x", "the")) for _ in range(30_000))
    want = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model()).encode(text, add_eos=True)
    row = pieces.encode_pieces(spark.createDataFrame([(1, text)], "doc_id long, text string"), pieces.default_model()).first()
    assert row.ids_text == " ".join(map(str, want))


def test_benchmark_window_of_many_items(spark):
    passage = " ".join(f"w{i}" for i in range(14))
    items = [(i, f"{passage} own{i}") for i in range(300)]
    docs = [(1, "before " + passage + " after " + passage), (2, "nothing of it")]
    out = decontaminate.find_benchmark(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in out.collect()) == [(1, 30, 28, 300), (2, 3, 0, 0)]
