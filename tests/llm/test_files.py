"""Token-id files and archives: round trips, the library, SQL."""

import gzip
import random
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from cairnflow.llm import common, token_files, warc


def test_ranks_round_trip():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = rnd.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) >> rnd.integers(0, 32, n, dtype=np.uint32)
        control, data = token_files.pack_ranks(ranks)
        assert len(control) == -(-n // 4)
        assert token_files.unpack_ranks(control, data, n).tolist() == ranks.tolist()


def texts():
    rnd = random.Random(4)
    words = ["the", "it's", "naïve", "12,5", "<|endoftext|>", "a<|startoftext|>b", "é", " ", "\x1c", "中文", "ẞΣ", "🙂", " x", "x" * 50, "ΑΣ"]
    return [" ".join(rnd.choice(words) for _ in range(n)) for n in range(40)] + ["\t a\n b\r", "word " * 20_000]


def test_parts_match_library():
    spec = token_files.tokenizer_spec()
    whole = Tokenizer.from_str(spec)
    odd = [", . the 12 x é", "the, the. 12. é, x,, x.. x, x., <, ,", "THE. A. a<, it's, it's.", "a\x01b \x01 \x01\x01", "", None, "<|STARTOFTEXT|> A<|endoftext|>B", "ÀÉ İstanbul"]
    tok = token_files.PartTokenizer(spec)
    tok.lists.most = 20
    for _ in range(2):
        ids, bounds = tok.encode([*texts(), *odd])
        got = [x.tolist() for x in np.split(ids, bounds[1:-1])]
        assert got == [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for t in [*texts(), *odd]]


def test_token_files(spark):
    spec = token_files.tokenizer_spec()
    whole = Tokenizer.from_str(spec)
    rows = [(200 - k, t) for k, t in enumerate(texts())] + [(3, None), (2, ""), (None, "no id"), (7, "same id"), (7, "same id"), (7, "other text here")]
    df = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id long, text string, n_tokens int, part string").repartition(3)
    encoded = common.written(token_files.encode_texts(df, spec), "t")
    path = common.scratch_path(spark, "t")
    token_files.write_files(encoded, token_files.id_type(spec), path)
    got = sorted(token_files.read_files(spark, path).collect(), key=lambda r: r.start)
    want = [(i, [*whole.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]
    want.sort(key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))
    start = 0
    for r, (i, ids) in zip(got, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    # small frames and files, and a limit of the session's own
    small = common.scratch_path(spark, "t")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 1)
    try:
        token_files.write_files(encoded, token_files.id_type(spec), small, frame_ids=50, file_frames=2)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert spark.read.format("binaryFile").load(f"{small}/ids").count() > 10
    assert sorted(token_files.read_files(spark, small).collect(), key=lambda r: r.start) == got
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    assert [r.n for r in ranks] == sorted((r.n for r in ranks), reverse=True)


def test_tokenizers_of_another_kind():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    tok, whole = token_files.PartTokenizer(spec), Tokenizer.from_str(spec)
    assert not tok.by_parts and token_files.PartTokenizer(token_files.tokenizer_spec()).by_parts
    ids, bounds = tok.encode(texts())
    assert [x.tolist() for x in np.split(ids, bounds[1:-1])] == [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in texts()]


def test_token_files_of_ties(spark):
    """Ids of equal frequency rank by id; equal rows stay side by side."""
    spec = token_files.tokenizer_spec()
    df = spark.createDataFrame([(k % 2, "a b c") for k in range(40)], "doc_id long, text string").repartition(5)
    path = common.scratch_path(spark, "t")
    token_files.write_files(common.written(token_files.encode_texts(df, spec), "t"), token_files.id_type(spec), path)
    got = sorted(token_files.read_files(spark, path).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start) for r in got] == [(k // 20, 4 * k) for k in range(40)]
    ranks = [r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    assert ranks == sorted(ranks)


def test_token_files_empty(spark):
    spec = token_files.tokenizer_spec()
    df = spark.createDataFrame([], "doc_id long, text string")
    path = common.scratch_path(spark, "t")
    token_files.write_files(token_files.encode_texts(df, spec), "<u2", path)
    assert token_files.read_files(spark, path).count() == 0


def page_rows():
    big, other = "<p>" + "x" * 200, "é" * 90
    rows = [(k, f"http://a/{k}", h) for k, h in enumerate([big, "", None, "tiny", "tiny", other, big + "!", "a\r\n\r\nb" * 40])]
    rows += [(30, "http://b", big), (20, None, big), (25, "u\nv", other), (30, "http://b", big), (None, "n", big), (40, "http://a/0", "z" * 99), (41, "x", "z" * 99)]
    return rows


def test_archives(spark):
    rows = page_rows()
    df = spark.createDataFrame([(*r, "d", "t") for r in rows], "page_id long, url string, html string, digest string, record_type string").repartition(3)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        first = min(same, default=None)
        again = len(body) >= 100 and first is not None and i != first
        want.append((i, len(body), "revisit" if again else "response", first if again else None, None if again else body))
    for limit in (200_000, 0):
        records = warc.captures(df)
        path = common.scratch_path(spark, "w")
        warc.write_archives(records, warc.resolve(records, broadcast_rows=limit), path, broadcast_rows=limit)
        read = common.written(warc.read_archives(spark, path), "r")
        got = warc.with_originals(read, broadcast_rows=limit).collect()
        assert sorted(((r.page_id, r.n_bytes, r.record_type, r.refers_to) for r in got), key=str) == sorted((x[:4] for x in want), key=str)
        payloads = {(r.page_id, bytes(r.payload)) for r in read.collect() if r.record_type == "response"}
        assert payloads == {(i, b) for i, _, t, _, b in want if t == "response"}
        files = spark.read.format("binaryFile").load(path).select("content").collect()
        assert sum(gzip.decompress(bytes(f.content)).count(b"WARC/1.1\r\n") for f in files if len(f.content)) == len(rows)


def test_archives_of_small_runs_and_long_payloads(spark):
    rows = [(k, f"http://a/{k}", f"{k} " * 200) for k in range(300)] + [(900, "http://long", "long " * 1_000_000)]
    records = warc.captures(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    path = common.scratch_path(spark, "w")
    warc.write_archives(records, warc.resolve(records), path, run_bytes=200)
    assert spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).count() > 2
    got = warc.read_archives(spark, path).select("page_id", "n_bytes").collect()
    assert sorted(map(tuple, got)) == [(i, len(h)) for i, _, h in rows]


def test_archives_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    records = warc.captures(df)
    path = common.scratch_path(spark, "w")
    warc.write_archives(records, warc.resolve(records), path)
    assert warc.with_originals(warc.read_archives(spark, path)).count() == 0


def test_archives_match_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    want = con.sql(warc.ORACLE_OP2).fetchall()
    got = [tuple(r) for r in warc.op2(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)


def test_scratch(spark):
    df = spark.range(10)
    with common.scratch_dropped():
        table = common.written(df, "t")
        kept_by_name = common.scratch_path(spark, "t")
        path = table.inputFiles()[0].rpartition("/")[0]
        assert common.written(df, "t", path=kept_by_name).count() == 10
    hadoop = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    assert not hadoop(path) and not hadoop(kept_by_name)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    common.written(df.mapInArrow(lambda b: b, "id long"), "t")
    assert spark.conf.get(key) == before

    class Unset:
        master = "spark://host:7077"

        def get(self, *_):
            return None

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return self

    class Session:
        conf = sparkContext = Unset()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.scratch_dir(Session())
