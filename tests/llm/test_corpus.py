"""Mixing, archives, packing and the pipeline."""

import base64
import hashlib
import io
import os
import zipfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from keyflux.llm import mixing, packing, quality, warc

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def brute_targets(sizes):
    """Share by weight; cap what is above and reshare the excess until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        t = {s: rest * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if t[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return capped | t
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_targets(spark):
    rnd = np.random.default_rng(0)
    for _ in range(4):
        sizes = {f"s{i}": int(10 ** rnd.uniform(0, 4)) for i in range(9)} | {None: 50, "é": 0}
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = brute_targets(sizes)
        assert {r["source"]: r["target"] for r in got} == {s: pytest.approx(t, abs=1e-6) for s, t in want.items()}


def test_rates_solve_the_dual(spark):
    rnd = np.random.default_rng(1)
    rows = [(s, int(x), 1) for s in "ab" for x in rnd.lognormal(4, 1, 300)]
    total = {s: sum(x for t, x, _ in rows if t == s) for s in "ab"}
    goal = spark.createDataFrame([(s, total[s], total[s] * f, 300) for s, f in (("a", 0.3), ("b", 2.2))], "key string, source_size long, target double, docs long")
    lam = {r["key"]: r for r in mixing.balance(spark.createDataFrame(rows, "key string, size long, n long"), goal).collect()}
    for s, f in (("a", 0.3), ("b", 2.2)):
        rate = [min(3.0, np.exp(lam[s]["lam"] * x / lam[s]["mean"])) for t, x, _ in rows if t == s]
        assert sum(r * x for r, (t, x, _) in zip(rate, [r for r in rows if r[0] == s])) == pytest.approx(f * total[s], rel=1e-6)


def test_mix(spark, odd_docs, no_docs):
    rnd = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(n)), ["a", "b", "c", "d", None][i % 5] if i % 2 else "a") for i, n in enumerate(rnd.lognormal(4, 1, 1500))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    pick = lambda rows: sorted((r["doc_id"], r["mix_copies"]) for r in rows)
    assert pick(got) == pick(again) and len(got) == 1500
    sizes = {}
    for r in got:
        assert r["mix_size"] == len(r["text"].split()) and 0 <= r["mix_copies"] <= 3
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["mix_size"]
    want = brute_targets(sizes)
    for s in sizes:
        assert sum(r["mix_size"] * r["mix_copies"] for r in got if r["source"] == s) == pytest.approx(want[s], rel=0.01)
    odd = mixing.mix(odd_docs.withColumn("mix_size", F.lit("x")).withColumn("key", F.lit(1)).withColumn("h", F.lit(1)))
    assert odd.columns[: len(odd_docs.columns) + 2] == [*odd_docs.columns, "key", "h"] and odd.columns.count("mix_size") == 1 and odd.count() == odd_docs.count() and mixing.mix(no_docs).count() == 0
    assert {r["mix_size"] for r in odd.filter("doc_id in (3, 4, 5)").collect()} == {0}


def test_mix_of_repeated_rows(spark, monkeypatch):
    """Few rows many times over, null ids among them; every source meets its target within 2 %."""
    text = lambda n, w="w": " ".join([w] * n)
    rows = [(i, text(50), "a") for i in range(3)] * 100 + [(1000 + i, text(50), "b") for i in range(300)]
    rows += [(None, text(20, f"z{i % 3}"), "c") for i in range(300)] + [(7, text(30), "d")] * 1000 + [(None, None, None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pick = lambda rows: sorted(((r["doc_id"] or -1), r["source"] or "", r["text"] or "", r["mix_copies"]) for r in rows)
    got = mixing.mix(df).collect()
    assert pick(got) == pick(mixing.mix(df.repartition(5)).collect())
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert pick(got) == pick(mixing.mix(df).collect())
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["mix_size"]
    want = brute_targets(sizes)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert sum(r["mix_size"] * r["mix_copies"] for r in mine) == pytest.approx(want[s], rel=0.02)
        assert all(0 <= r["mix_copies"] <= 3 and r["mix_source_size"] == sizes[s] and r["mix_target"] == pytest.approx(want[s]) for r in mine)
    assert len(got) == len(rows)


def test_mix_runs_no_python(spark, odd_docs):
    plan = mixing.mix(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    schema = "page_id long, url string, html string, sha string, top long, revisits int"
    html = ["a", "a", None, "", "é\r\n\r\nWARC/1.0", "a", "unique", "x" * 300_000, "only null"]
    ids = [1, 5, 2, 3, 4, None, 6, 7, None]
    rows = [(i, None if i == 6 else f"http://x/{i}\n y", h, "s", 1, 1) for i, h in zip(ids, html)] + [(6, "u", "a", "s", 1, 1), (8, "u", "same", "s", 1, 1), (8, "u", "same", "s", 1, 1)]
    got = warc.round_trip(spark.createDataFrame(rows, schema)).collect()
    top = {}
    for i, _, h, *_ in rows:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    want = []
    for i, _, h, *_ in rows:
        p = (h or "").encode()
        t = top.get(h or "")
        revisit = t is not None and i != t
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", t if revisit else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert warc.round_trip(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("rows_", [0, 400_000])
def test_warc_of_many_rows_without_ids(spark, monkeypatch, rows_):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", rows_)
    rows = [(None, "u", f"page {i % 700}") for i in range(2100)] + [(i, "u", f"page {i}") for i in range(300)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 2400 and sum(r["record_type"] == "revisit" for r in got) == 900
    assert all((r["refers_to"] is not None) == (r["record_type"] == "revisit") for r in got) and all(r["record_type"] == "response" for r in got if r["page_id"] is not None)


def test_folders_of_archives(spark):
    with pytest.raises(ValueError, match="can't be kept"):
        warc.write_archives(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), "gopher://host/folder")
    assert warc.file_system("/a/b")[1] == "/a/b" and warc.file_system("file:///a/b")[1] == "/a/b"
    fs, path = warc.file_system("s3a://bucket/key?region=us-east-1")
    assert type(fs).__name__ == "S3FileSystem" and path == "bucket/key"


def test_zip64_directory():
    out = io.BytesIO()
    w = warc.ArchiveWriter(out)
    for i in range(50):
        w.add(warc.record(i, "u", b"p%d" % i, warc.digest(b"p%d" % i), None), "response", warc.digest(b"p%d" % i))
    w.close()
    with zipfile.ZipFile(io.BytesIO(out.getvalue()), "a") as z:  # more members than the plain end record counts
        z.comment = b"PK\x05\x06 in a comment"
        for i in range(66_000):
            z.writestr(f"f{i}", b"")
        out = z.fp
    data = out.getvalue()
    r = warc.ArchiveReader(io.BytesIO(data), len(data))
    assert len(r.members) == 66_002 and [b for _, b in r.records()] == [b"p%d" % i for i in range(50)]
    assert warc.EOCD64 in data
    with pytest.raises(ValueError):
        warc.ArchiveReader(io.BytesIO(data[:-1000]), len(data) - 1000)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=25))
def test_plans_fill_sequences(counts):
    runs = packing.plan(counts, 40)
    seen, room = {k: [] for k in counts}, {}
    for length, rank, first, n, offset in runs:
        seen[length] += range(rank, rank + n)
        for s in range(first, first + n):
            room.setdefault(s, []).append((offset, length))
    assert all(sorted(v) == list(range(counts[k])) for k, v in seen.items())
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 40
    plain: list[int] = []  # first fit, longest first
    for k in sorted(counts, reverse=True):
        for _ in range(counts[k]):
            at = next((i for i, r in enumerate(plain) if r >= k), None)
            if at is None:
                plain.append(40 - k)
            else:
                plain[at] -= k
    assert len(room) <= len(plain) + 1


@pytest.mark.parametrize("counts, least", [({1500: 1, 1400: 1}, 1), ({2000: 1, 1900: 1, 1800: 1, 1700: 1}, 2), ({2048: 3, 1000: 2}, 2), ({2048: 1}, 1)])
def test_the_last_of_a_length_shares_its_sequence(counts, least):
    runs = packing.plan(counts, 4096)
    assert sum(n for _, _, _, n, _ in runs) == sum(counts.values())
    assert len({s for _, _, first, n, _ in runs for s in range(first, first + n)}) == least


def fewest(pieces, size):
    """Sequences of a best packing, by trying all."""
    best = [len(pieces)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= pieces[i]}.values():
            put(i + 1, [*rooms[:k], rooms[k] - pieces[i], *rooms[k + 1 :]])
        put(i + 1, [*rooms, size - pieces[i]])

    put(0, [])
    return best[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_a_dominating_set_is_in_a_best_packing(pieces):
    pieces.sort(reverse=True)
    least = fewest(pieces, 20)
    assert packing.least_sequences(dict(Counter(pieces)), 20) <= least
    for a in set(pieces):
        left = np.bincount(pieces, minlength=21)
        chosen = packing.dominating(left, a, 20)
        if chosen:
            rest = list(pieces)
            for x in chosen:
                rest.remove(x)
            assert a in chosen and sum(chosen) <= 20 and 1 + fewest(rest, 20) == least, (pieces, chosen)


@pytest.mark.parametrize("pieces, a, chosen", [((12, 5, 3, 3, 3), 12, (12, 5, 3)), ((12, 7, 4, 2), 12, (12, 7)), ((11, 5, 5, 4, 4, 4), 11, (11, 5, 4)), ((12, 5, 4, 3, 3), 12, (12, 5, 3)), ((12, 6, 4, 4, 2), 12, ()), ((12, 3, 3, 2), 12, ()), ((20, 1), 20, (20,))])
def test_dominating_sets(pieces, a, chosen):
    assert packing.dominating(np.bincount(pieces, minlength=21), a, 20) == chosen


def check_pieces(docs, got):
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want, full = [], {}
    for d, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((-1 if d is None else d, k // 4096, k, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    assert sorted(want) == sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    for r in got:
        full.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in full.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(full), -(-sum(w[3] for w in want) // 4096)


def test_packing_of_odd_documents(odd_docs, no_docs):
    check_pieces([(r["doc_id"], r["text"]) for r in odd_docs.collect()], packing.pack(odd_docs).collect())
    assert packing.pack(no_docs).count() == 0


@tables
def test_packing_is_tight(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 3)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, least = check_pieces([(r["doc_id"], r["text"]) for r in docs.collect()], packing.pack(docs).collect())
    assert n <= least * 1.02 + 1


@pytest.mark.parametrize("counts", [1_000_000, 0])
def test_pieces_are_ranked_where_they_are_cut_or_by_salted_groups(spark, odd_docs, no_docs, monkeypatch, counts):
    """An exchange with two sorts for each row took executors most of their heap."""
    monkeypatch.setattr(packing, "COUNTS", counts, raising=False)
    monkeypatch.setattr(packing, "GROUP", 3)
    many = spark.range(0, 300, 1, 7).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', cast(id % 11 * (id % 3) as int))").alias("text"))
    for docs in (odd_docs.repartition(3), many):
        docs = docs.select("doc_id", "text").persist()
        out = packing.pack(docs)
        assert ("Exchange" in out._jdf.queryExecution().executedPlan().toString()) == (counts == 0)
        rows = out.collect()
        n, least = check_pieces([(r["doc_id"], r["text"]) for r in docs.collect()], rows)
        assert n <= least * 1.02 + 1
        assert sorted(map(str, rows)) == sorted(map(str, out.collect()))
        docs.unpersist()
    assert packing.pack(no_docs).count() == 0


@pytest.mark.parametrize(("own", "want"), [(None, "256"), ("1000", "1000")])
def test_packing_reads_few_texts_at_a_time(spark, odd_docs, monkeypatch, own, want):
    key, seen, write = "spark.sql.parquet.columnarReaderBatchSize", [], packing.materialize
    monkeypatch.setattr(packing, "materialize", lambda df, label: (seen.append(spark.conf.get(key)), write(df, label))[1])
    if own:
        spark.conf.set(key, own)
    try:
        packing.pack(odd_docs)
        assert seen == [want] and spark.conf.get(key) == (own or "4096")
    finally:
        spark.conf.unset(key)


@tables
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        rows = out.collect()
        if name == "quality":
            ok = {r["doc_id"] for r in quality.classify(now, labels).filter("predicted = 1").collect()}
            assert {r["doc_id"] for r in rows} == ok
        elif name == "near_dedup":
            from test_dedup import brute_texts

            comp = brute_texts([(r["doc_id"], r["text"]) for r in now.collect()], 5)
            assert {r["doc_id"] for r in rows} == {d for d, c in comp.items() if d == c}
        elif name == "secrets":
            from test_text import brute_spans

            assert len(rows) == now.count() and not any(brute_spans(r["text"] or "") for r in rows)
        elif name == "mix":
            assert 0.9 < sum(len(r["text"].split()) for r in rows) / sum(len(r["text"].split()) for r in now.collect()) < 1.1
        else:
            check_pieces([(r["doc_id"], r["text"]) for r in now.collect()], rows)
            break
        assert out.columns == docs.columns
        now = spark.createDataFrame(rows, docs.schema)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_odd_documents(spark, odd_docs, no_docs, tmp_path, name, stage):
    """Nulls, empty and long texts, repeats, foreign columns, no rows: what each stage's docstring says."""
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (6, 1, 0), (None, 1, 1), (12, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert stage(spark, no_docs, str(tmp_path)).count() == 0
    before = [tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in odd_docs.collect()]
    out = stage(spark, odd_docs, str(tmp_path))
    rows = out.collect()
    if name == "pack":
        check_pieces([r[:2] for r in before], rows)
        return
    assert out.columns == list(corpus_pipeline.COLUMNS)
    got, key = [tuple(r) for r in rows], lambda r: tuple(str(x) for x in r)
    if name == "quality":
        scores = quality.classify(odd_docs, labels).collect()
        ok = sorted(str(r["doc_id"]) for r in scores if r["predicted"])
        assert sorted(str(r[0]) for r in got) == ok and set(got) <= set(before)
        labels.limit(0).write.mode("overwrite").parquet(str(tmp_path / "none" / "labels.parquet"))
        assert sorted(map(key, stage(spark, odd_docs, str(tmp_path / "none")).collect())) == sorted(map(key, before))
    elif name == "near_dedup":
        assert {r[0] for r in got} >= {None, 1, 3, 4, 5, 8} and not {r[0] for r in got} & {2, 7, 9, 10}
    elif name == "secrets":
        assert len(got) == len(before)
        for r in got:
            if r[0] == 13:
                assert r[1] == "[REDACTED] \u00e9 [REDACTED]" and r[4] == len(r[1])
            else:
                assert r in before
    else:
        assert set(got) <= set(before) and {r[0] for r in got} >= {3, 4, 5}
        words = lambda rs: sum(len((r[1] or "").split(" ")) for r in rs if r[0] in (6, 7, 12))
        assert 0 < words(got) <= 3 * words(before)


@tables
def test_run(spark):
    assert corpus_pipeline.run(spark, SF).agg(F.count("*")).first()[0] > 0
