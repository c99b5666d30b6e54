import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from tracklake.llm import classifier, decontaminate, lengths, lines, pieces, repeats, rules, secrets, simhash, substring, suffixes
from tracklake.llm.common import KEY
from tracklake.llm.registry import ORACLES, QUERIES


def got(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


# --- registered queries on whole small tables ------------------------------------


def test_op1(spark, sf_dir, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    out = got(QUERIES["op1_benchmark"](spark, sf_dir), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert out == sorted(brute.benchmark_hits(texts, items)) and any(r[5] for r in out)


def test_op2(spark, sf_dir, texts):
    frame = QUERIES["op2_quality_rules"](spark, sf_dir)
    assert got(frame, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(brute.measures(texts))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    verdicts = [(r.kept, labels[r.doc_id]) for r in frame.collect() if r.doc_id in labels and not r.base_failed]
    assert all(kept for kept, good in verdicts if good)
    assert sum(not kept for kept, good in verdicts if not good) >= 0.8 * sum(not good for _, good in verdicts)


def test_op3(spark, sf_dir, texts):
    texts = sorted(texts)
    prints = [brute.fingerprint(t) for _, t in texts]
    roots = brute.components(prints)
    want = sorted((d, f"{p:016x}", texts[r][0]) for (d, _), p, r in zip(texts, prints, roots, strict=True))
    assert got(QUERIES["op3_simhash"](spark, sf_dir), "doc_id", "fingerprint", "component_id") == want


def _library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def _encoded(model, doc, text):
    ids = model.encode(text or "", add_eos=True)
    return doc, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(model.decode(ids))


def test_op4(spark, sf_dir, texts):
    model = _library()
    assert got(QUERIES["op4_pieces"](spark, sf_dir), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(_encoded(model, d, t) for d, t in texts)


def test_op5(spark, sf_dir, texts):
    import public_tokenizers

    encoding = lengths._encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    n = sorted(len(encoding.encode_ordinary(t or "")) for _, t in texts)
    frame = QUERIES["op5_token_counts"](spark, sf_dir).cache()
    want = [(x, n.count(x), sum(y > x for y in n), sum(y for y in n if y <= x), sum(min(y, x) for y in n)) for x in sorted(set(n))]
    assert got(frame, "n_tokens", "n_docs", "docs_longer", "tokens_upto", "tokens_truncated") == want
    for limit in (0, 1, 100, 777, 10**6):
        assert tuple(lengths.at_limit(frame, limit).first()) == (limit, sum(y > limit for y in n), sum(min(y, limit) for y in n))
    assert lengths.quantile(frame, 0.5).first()[0] == n[(len(n) + 1) // 2 - 1]


def test_op6(spark, sf_dir, texts):
    frame = QUERIES["op6_secrets"](spark, sf_dir)
    want = sorted((d, *brute.secrets(t)[:3], brute.sha(brute.secrets(t)[3])) for d, t in texts)
    assert got(frame, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want


def test_op7_separates_held_out_rows(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    out = [r for r in QUERIES["op7_quality"](spark, folder).collect()]
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [(r.score, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum((s >= 0.5) == bool(y) for s, y in held) / len(held) > 0.93


def test_op8(spark, sf_dir, texts):
    def spark_hashes(strings):
        frame = spark.createDataFrame([(s,) for s in strings], "s string")
        return {r.s: r.h for r in frame.select("s", F.xxhash64("s").alias("h")).collect()}

    line = spark_hashes({x for _, t in texts for x in (t or "").split("\n")})
    pairs = {(line[a] if a is not None else None, line[b]) for _, t in texts for a, b in zip([None, *(t or "").split("\n")], (t or "").split("\n"), strict=False)}
    frame = spark.createDataFrame(list(pairs), "a long, b long")
    pair = {(r.a, r.b): r.h for r in frame.select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    seen, want = set(), set()
    for doc, text in sorted(texts):
        for start, body in brute.line_chunks(text, line.get, lambda a, b: pair[a, b]):
            if body in seen:
                want.add((doc, start, body.count("\n") + 1))
            seen.add(body)
    chunks, rims = lines.repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert want and set(got(chunks, "doc_id", "start", "size")) == want
    inside = {(d, i) for d, start, size in want for i in range(start, start + size - 1)}
    assert all((r.doc_id, r.start) not in inside for r in rims.where("size = 2").collect())
    whole = _without_repeats([(d, t or "") for d, t in texts])
    want = sorted((d, len((t or "").split("\n")), whole[d][0], brute.sha(whole[d][1])) for d, t in texts)
    assert got(QUERIES["op8_line_dedup"](spark, sf_dir), "doc_id", "n_lines", "n_removed", "kept_sha256") == want
    assert any(r[2] for r in want)


def test_op9(spark, sf_dir, texts):
    out = got(QUERIES["op9_substring_dedup"](spark, sf_dir), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert out == sorted(brute.substrings(texts)) and any(r[2] for r in out)


def test_op10(spark, sf_dir, texts):
    out = got(QUERIES["op10_suffix_dedup"](spark, sf_dir), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert out == sorted(brute.suffixes(texts)) and any(r[2] for r in out)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    columns = want.columns
    assert got(QUERIES[name](spark, sf_dir), *columns) == sorted(want.fetchall())


# --- odd rows ----------------------------------------------------------------------


def test_odd_rows_in_each_operator(spark, odd_docs, odd_frame):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "w1"), (None, odd_docs[3][1]), (5, "One"), (5, "weird")], "item_id long, text string")
    found = decontaminate.find_benchmark(odd_frame, items).withColumn("sha", F.sha2("items", 256))
    assert got(found, "doc_id", "n_words", "n_hit", "n_items", "sha", "contaminated") == sorted(brute.benchmark_hits(odd_docs, [tuple(r) for r in items.collect()]))
    assert got(rules.judge(odd_frame), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(brute.measures(odd_docs))
    prints = [brute.fingerprint(t) for _, t in odd_docs]
    roots = brute.components(prints)
    assert got(simhash.near_duplicates(odd_frame), "doc_id", "component_id") == [(d, odd_docs[r][0]) for (d, _), r in zip(odd_docs, roots, strict=True)]
    model = _library()
    assert got(pieces.token_digests(odd_frame, pieces.default_model()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(_encoded(model, d, t) for d, t in odd_docs)
    assert got(secrets.scan_secrets(odd_frame), "doc_id", "n_assign", "n_access", "n_hex", "base_spans") == sorted((d, *brute.secrets(t)) for d, t in odd_docs)
    assert got(substring.dedup_substrings(odd_frame), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substrings(odd_docs))
    assert got(suffixes.dedup_suffixes(odd_frame), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.suffixes(odd_docs))
    whole = _without_repeats([(d, t or "") for d, t in odd_docs])
    assert got(lines.dedup_lines(odd_frame), "doc_id", "n_lines", "n_removed", "kept_text") == sorted((d, (t or "").count("\n") + 1, *whole[d]) for d, t in odd_docs)
    marks = spark.createDataFrame([(4, 1), (11, 0), (None, 1), (5, None), (4, 1)], "doc_id long, quality int")
    scores = classifier.classify(odd_frame, marks)
    assert scores.count() == len(odd_docs) and scores.where("score IS NULL OR score < 0 OR score > 1").count() == 0


def test_empty_tables(spark, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    marks = spark.createDataFrame([], "doc_id long, quality int")
    frames = [
        decontaminate.find_benchmark(no_docs, none), rules.judge(no_docs), simhash.near_duplicates(no_docs), pieces.token_digests(no_docs, pieces.default_model()), secrets.scan_secrets(no_docs), classifier.classify(no_docs, marks), lines.dedup_lines(no_docs), substring.dedup_substrings(no_docs),
        suffixes.dedup_suffixes(no_docs), lengths.length_histogram(spark.createDataFrame([], "doc_id long, n_tokens long")), decontaminate.decontaminate(no_docs, none), lines.drop_repeated_lines(no_docs), simhash.drop_near_duplicates(no_docs), classifier.keep_good(no_docs, marks),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_null_ids_and_repeated_rows(spark, odd_docs):
    passage = odd_docs[3][1]
    frame = spark.createDataFrame([(None, passage), (4, passage), (4, passage), (6, passage), (6, "other " * 3)], "doc_id long, text string")
    assert [r.n_removed for r in substring.dedup_substrings(frame).orderBy("doc_id", "n_words", "n_removed").collect()] == [0, 0, 0, 0, 80]
    assert [r.n_removed > 0 for r in suffixes.dedup_suffixes(frame).orderBy("doc_id", "n_bytes").collect()] == [False, False, False, False, True]
    assert sorted(str(r.component_id) for r in simhash.near_duplicates(frame).collect()) == ["4", "4", "4", "4", "6"]
    assert simhash.drop_near_duplicates(frame).count() == 2
    assert lines.dedup_lines(frame).count() == 5
    assert decontaminate.find_benchmark(frame, spark.createDataFrame([(1, passage)], "item_id long, text string")).where("contaminated").count() == 4


# --- methods ------------------------------------------------------------------------


def test_benchmark_in_several_blocks_gives_the_same_rows(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = decontaminate.find_benchmark(docs, items), decontaminate.find_benchmark(docs, items, block_bytes=2000)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated")
    assert got(one, *columns) == got(many, *columns)
    clean = {r.doc_id for r in one.where("NOT contaminated").collect()}
    assert {r.doc_id for r in decontaminate.decontaminate(docs, items, block_bytes=2000).collect()} == clean


def test_windows_with_equal_middles_are_not_equal(spark):
    """Made to have one 64-bit hash of 100 bytes; only the middle 60 are equal."""
    pair = (
        "biqpasbdriryizpzubivmntyadvygiwlhvgkqocawtvnviludhdlzdjkxfngatbhmmdztzcshoyhseizclpwkjznjyqgvsdmoukj",
        "hxnhbzalrfjfpmdzyqaqmntyadvygiwlhvgkqocawtvnviludhdlzdjkxfngatbhmmdztzcshoyhseizkawrrtqxyqerduwypyip",
    )
    frame = spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string")
    assert got(suffixes.dedup_suffixes(frame), "n_removed", "n_spans") == [(0, 0), (0, 0)]


@pytest.mark.parametrize(("width", "gram", "filter_bytes"), [(5, 2, repeats.FILTER_BYTES), (8, 8, 0), (12, 3, 0)])
def test_repeats_on_small_alphabets(spark, monkeypatch, width, gram, filter_bytes):
    monkeypatch.setattr(repeats.repeated_spans, "__defaults__", (filter_bytes,))
    rng = random.Random(width)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    docs += [(100 + i, docs[i][1]) for i in range(0, 40, 3)] + [(200 + i, docs[i][1] + " c " + docs[i + 1][1]) for i in range(0, 30, 4)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(substring.dedup_substrings(frame, width, gram), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substrings(docs, width))
    assert got(suffixes.dedup_suffixes(frame, 2 * width, gram), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.suffixes(docs, 2 * width))


def test_hot_passage_needs_one_row_for_each_class(spark):
    shared = " ".join(f"p{i}" for i in range(120))
    docs = [(i, f"a{i} b{i} {shared} c{i}") for i in range(200)]
    spans = repeats.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string"), repeats.Windows(50, 16, True), within=False)
    assert {r.doc_id for r in spans.select("doc_id").distinct().collect()} == set(range(1, 200))


def test_close_pairs_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = list(base)
    for v in base:
        for _ in range(6):
            for bit in rng.choice(64, rng.integers(1, 7), replace=False):
                v = v ^ np.uint64(1 << int(bit))
            values.append(v)
    v = np.unique(np.array(values, np.uint64))
    signed = v.view(np.int64)
    want = {(int(min(signed[x], signed[y])), int(max(signed[x], signed[y]))) for x, y in zip(*np.nonzero(np.bitwise_count(v[:, None] ^ v[None]) <= 4), strict=True) if x != y}
    pairs = simhash.close_pairs(spark.createDataFrame([(int(x),) for x in signed], "fp long")).collect()
    assert len(pairs) == len({tuple(p) for p in pairs}) and {tuple(p) for p in pairs} == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 61), 100, 101, 200]], "node long")
    assert {r.node: r.root for r in simhash.components(edges, nodes).collect()} == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 200: 200}


def test_codec_against_the_library():
    model, own = _library(), pieces.PieceCodec(pieces.default_model())
    rng = random.Random(2)
    letters = "abcdefgh   \n\t▁éß日本語😀aaaatheing<>/s._-0123456789"
    cases = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(800)] + ["", " ", "  ", "▁", "\n", " \n ", "a\x00b", "<s></s><unk><0x0A>", "x" * 400, "aaaa " * 200]
    for text in cases:
        ids = model.encode(text, add_eos=True)
        assert own.encode(text) == ids
        assert own.decode(ids) == model.decode(ids)


def test_token_pairs_that_merging_would_not_leave_are_incompatible():
    own = pieces.PieceCodec(pieces.default_model())
    assert own.remerge("▁the") == ["▁the"] and not own.compatible("▁t", "he") and own.compatible("▁the", "▁")


def test_random_tokens_are_added_and_base_spans_stay(spark):
    rng = random.Random(4)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(44))
    docs = [(1, f"see {key} here"), (2, "password = hunter22 and é AKIA" + "Q" * 16 + " tail"), (3, "some/path/to/a/file/in/the/tree only")]
    out = {r.doc_id: r.spans for r in secrets.scan_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[1] == f"random:4:{4 + len(key)}" and out[2] == "assign:0:19,access:26:46" and out[3] == ""


def test_shifted_lines_keep_their_chunks(spark):
    body = "\n".join(f"line number {i} of the shared passage" for i in range(40))
    docs = [(1, body), (2, "new first line\n" + body + "\nand a new last one"), (3, "unrelated\ntext")]
    out = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[1].n_removed == 0 and out[3].n_removed == 0 and 25 <= out[2].n_removed <= 40
    assert out[2].kept_text.startswith("new first line") and out[2].kept_text.endswith("and a new last one")


def test_kept_digest_is_of_the_kept_text(spark, odd_frame):
    for r in substring.dedup_substrings(odd_frame).collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    assert KEY == "tl_row_key"


def _without_repeats(docs):
    """Passages of two or more lines grown line by line from every byte-equal pair that stands in an earlier place."""
    split = {d: t.split("\n") for d, t in docs}
    first, out = {}, {}
    for d in sorted(split):
        x, gone = split[d], set()
        for i in range(len(x) - 1):
            if (x[i] + x[i + 1]).strip(" \t\n\x0b\x0c\r"):
                e, j = first.setdefault((x[i], x[i + 1]), (d, i))
                if (e, j) != (d, i):
                    y, a, b = split[e], 0, 2
                    while i > a and j > a and x[i - a - 1] == y[j - a - 1]:
                        a += 1
                    while i + b < len(x) and j + b < len(y) and x[i + b] == y[j + b]:
                        b += 1
                    gone |= set(range(i - a, i + b))
        out[d] = (len(gone), "\n".join(v for i, v in enumerate(x) if i not in gone))
    return out


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_every_repeated_passage_of_lines_goes(spark, monkeypatch, broadcast_rows):
    rng, docs = random.Random(7), []
    shared = [["shared %d line %d" % (p, i) for i in range(2 + p % 5)] for p in range(40)]
    for d in range(150):
        body = ["own %d line %d" % (d, i) for i in range(rng.randrange(6))]
        for p in rng.sample(shared, 2):
            at = rng.randrange(len(body) + 1)
            body[at:at] = ["own %d before %d" % (d, at), *p, "own %d after %d" % (d, at)]
        docs.append((d, "\n".join(body)))
    docs += [(200 + k, docs[k][1]) for k in range(30)]
    docs += [(300, "\n\nhead\n\n\n\nnext\n\n\n"), (301, "\n\nhead\n\n\n\nnext\n\n\n"), (302, "a b\nc d\na b\nc d\na b\nc d"), (303, "once\nonly once"), (304, "\n\n\n"), (305, "\n\n\n")]
    monkeypatch.setattr(lines.repeated_lines, "__defaults__", (4, broadcast_rows))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: (r.n_removed, r.kept_text) for r in lines.dedup_lines(frame).collect()}
    assert out == _without_repeats(docs)
    assert all(out[200 + k][1] == "" for k in range(30)) and out[301] == (10, "") and out[302][1] == "a b\nc d" and out[305][0] == 0
    left = {r.doc_id: r.text for r in lines.drop_repeated_lines(frame).collect()}
    assert left == {d: out[d][1] for d, t in docs if out[d][0] == 0 or out[d][1].strip()}


def test_secrets_written_as_name_and_value(spark):
    rng = random.Random(3)
    value = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for _ in range(4)]
    docs = [(1, f"export AWS_SECRET_ACCESS_KEY={value[0]}\n"), (2, f"https://store.example/object?name=report&sig={value[1]}&v=2"), (3, f"sig={value[2]}== end"), (4, f"plain {value[3]} here"), (5, "path=some/long/folder/of/files1/readme")]
    out = {r.doc_id: r.spans for r in secrets.scan_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    start = {d: t.index(value[d - 1]) for d, t in docs[:4]}
    assert out == {d: f"random:{start[d]}:{start[d] + 40 + 2 * (d == 3)}" for d in start} | {5: ""}
