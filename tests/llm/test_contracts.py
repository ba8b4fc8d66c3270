"""The registered queries themselves: rows of SQL, held-out rows, predictions, and what is learnt from."""

import os
import re
import struct
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from dossierlake.llm import media, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TABLES = ("documents", "embeddings", "labels", "benchmark")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_of_sql(spark, db, name):
    want = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    plain = lambda rows: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)
    assert plain(got.select(*columns).collect()) == plain(want.fetchall())


SPLITS = {"op7_quality_compression": (5, 0, 0.3, "quality"), "op8_toxicity_deobfuscation": (3, 1, 0.7, "toxic"), "op9_language_id": (4, 2, None, "lang")}


def copy_of(spark, folder, modulus, rest, column):
    """The tables with whatever may not be learnt from turned round: labels or languages of held-out rows, and other columns of all."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.lit("other"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    if column == "lang":
        docs = docs.withColumn("lang", F.when(crc, "xx").otherwise(F.col("lang")))
    else:
        docs = docs.withColumn("lang", F.lit("xx"))
        labels = labels.withColumn(column, F.when(crc, 1 - F.col(column)).otherwise(F.col(column)))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(SPLITS))
def test_held_out_rows_are_not_learnt_from(spark, tmp_path, name):
    modulus, rest, least, column = SPLITS[name]
    run = queries.queries()[name]
    got = {r["doc_id"]: r for r in run(spark, SF).collect()}
    ids = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert sorted(got) == sorted(ids)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % modulus == rest) and 0 <= r["score"] <= 1
        if least:
            assert r["predicted"] == int(r["score"] >= least)
    again = {r["doc_id"]: r for r in run(spark, copy_of(spark, str(tmp_path), modulus, rest, column)).collect()}
    assert {i: round(r["score"], 9) for i, r in got.items()} == {i: round(r["score"], 9) for i, r in again.items()}
    if column == "lang":
        true = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        assert "xx" not in {r["lang_pred"] for r in again.values()}
        assert sum(got[i]["lang_pred"] == true[i] for i in got if got[i]["held_out"]) >= 0.95 * sum(r["held_out"] for r in got.values())


class Bits:
    """Bits of a byte string, first bit first."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def read(self, n):
        value = 0
        for _ in range(n):
            value = value << 1 | self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
            self.at += 1
        return value

    def signed(self, n):
        value = self.read(n)
        return value - (1 << n) if value >> (n - 1) else value

    def unary(self):
        n = 0
        while not self.read(1):
            n += 1
        return n


def crc(data, poly, width):
    value = 0
    for b in data:
        value ^= b << (width - 8)
        for _ in range(8):
            value = (value << 1 ^ (poly if value >> (width - 1) & 1 else 0)) & ((1 << width) - 1)
    return value


def flac_samples(stream):
    """Samples of an 8-bit mono FLAC stream, read bit by bit from the format's description; checksums are checked."""
    assert stream[:4] == b"fLaC"
    at, last = 4, False
    while not last:
        last, kind, size = bool(stream[at] & 128), stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            total = int.from_bytes(stream[at + 14 : at + 22], "big") & ((1 << 36) - 1)
        at += 4 + size
    out = []
    while at < len(stream):
        b = Bits(stream[at:])
        assert b.read(15) == 0b111111111111100
        b.read(1)
        size_code, _rate, channels, bits, zero = b.read(4), b.read(4), b.read(4), b.read(3), b.read(1)
        assert channels == 0 and bits == 1 and zero == 0
        first = b.read(8)
        for _ in range(0 if first < 128 else (7 - (first ^ 0xFF).bit_length()) - 1):
            assert b.read(2) == 2
            b.read(6)
        n = {6: lambda: b.read(8) + 1, 7: lambda: b.read(16) + 1}.get(size_code, lambda: 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else 256 << (size_code - 8))()
        if _rate in (12, 13, 14):
            b.read(8 if _rate == 12 else 16)
        assert crc(stream[at : at + b.at // 8], 0x07, 8) == b.read(8)
        assert b.read(1) == 0
        kind = b.read(6)
        assert b.read(1) == 0  # no wasted bits
        if kind == 0:
            x = [b.signed(8)] * n
        elif kind == 1:
            x = [b.signed(8) for _ in range(n)]
        else:
            assert 8 <= kind <= 12 or kind >= 32
            order = kind - 8 if kind < 32 else kind - 31
            x = [b.signed(8) for _ in range(order)]
            # fixed predictors are linear ones with binomial coefficients
            weights, shift = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])[order] if kind < 32 else None, 0
            if weights is None:
                precision, shift = b.read(4) + 1, b.signed(5)
                weights = [b.signed(precision) for _ in range(order)]
            method, parts = b.read(2), 1 << b.read(4)
            assert method in (0, 1)
            for p in range(parts):
                rice = b.read(4 + method)
                count = n // parts - (order if p == 0 else 0)
                if rice == 15 + 16 * method:
                    width = b.read(5)
                    residuals = [b.signed(width) if width else 0 for _ in range(count)]
                else:
                    residuals = []
                    for _ in range(count):
                        v = b.unary() << rice | b.read(rice)
                        residuals.append(v >> 1 ^ -(v & 1))
                for e in residuals:
                    guess = sum(w * x[-1 - i] for i, w in enumerate(weights)) >> shift
                    x.append(e + guess)
        b.at += -b.at % 8
        end = at + b.at // 8
        assert crc(stream[at:end], 0x8005, 16) == struct.unpack(">H", stream[end : end + 2])[0]
        out += x
        at = end + 2
    assert len(out) == total
    return bytes(v + 128 for v in out)


@pytest.mark.parametrize("text", ["", "a", "hello world " * 40, "é漢\U0001f600" * 30, "x" * 9000, "".join(chr(33 + i * 7 % 90) for i in range(6000))])
def test_media_by_a_second_reader(text):
    payload = media.payload_of(text)
    assert flac_samples(media.encode([payload])[0]) == payload
    assert re.match(r"^n=\d+;", media.feature(payload))
