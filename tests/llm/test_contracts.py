"""Contracts of the operators: model-backed queries by second versions, odd columns, sources with damage."""

import gzip
import hashlib
import io
import math
import re
import unicodedata
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlattice.llm import common, decontam, langid, media, neardup, packing, queries, secrets, toxicity, warc

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# --- toxicity ------------------------------------------------------------------------------------


def word_hash(word: bytes) -> int:
    block = next(common.word_blocks([word], common.ALNUM_WORDS))
    return int(block.hashes[0])


def test_log_odds_are_those_of_the_definition():
    toxic, clean, n1, n0 = np.array([30.0, 2.0, 0.0]), np.array([1.0, 200.0, 50.0]), 400.0, 5000.0
    odds, deviation = toxicity.log_odds(toxic, clean, n1, n0)
    for k in range(3):
        share, value, spread = (toxic[k] + clean[k]) / (n1 + n0), 0.0, 0.0
        for sign, y, n in ((1, toxic[k], n1), (-1, clean[k], n0)):
            prior = toxicity.PRIOR * n * share + toxicity.FLOOR * n / (n1 + n0)
            weight = toxicity.PRIOR * n + toxicity.FLOOR
            value += sign * math.log((y + prior) / (n + weight - y - prior))
            spread += 1 / (y + prior)
        assert odds[k] == pytest.approx(value) and deviation[k] == pytest.approx(math.sqrt(spread))
    assert odds[0] > 0 > odds[1] and odds[2] < 0


def brute_score(model, text):
    """The score of a text word by word, with segments by their recursive definition."""
    known = dict(zip(model.hashes.tolist(), model.odds.tolist()))
    scores = []
    for word in words_of(text):
        block = next(common.word_blocks([word.encode()], common.ALNUM_WORDS, toxicity.HEADS))
        found = [known[int(h[0])] for h in (block.hashes, *reversed(block.prefixes)) if int(h[0]) in known]
        scores.append(found[0] if found else model.drift)

    def split(lo, hi):
        best, sums = None, [0.0]
        for s in scores[lo:hi]:
            sums.append(sums[-1] + s)
        low, at = 0.0, 0
        for k in range(1, len(sums)):
            if best is None or sums[k] - low > best[0]:
                best = (sums[k] - low, at, k)
            if sums[k] < low:
                low, at = sums[k], k
        if not best or best[0] <= 0:
            return []
        total, a, b = best
        return [*split(lo, lo + a), total, *split(lo + b, hi)]

    found = [model.decay * s - math.log(model.scale * max(len(scores), 1)) for s in split(0, len(scores))]
    evidence = -10.0
    if found:
        level = math.log(toxicity.SIGNIFICANT)
        good = [e for e in found if e > -level]
        evidence = max(max(found), sum(e + level for e in good) - level if good else max(found))
    return 1 / (1 + math.exp(-(model.slope * min(max(evidence, -10), 60) + model.shift)))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_toxicity_query_agrees_with_brute_force_and_hides_held_out_labels(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, in docs.select("doc_id").collect()}
    got = {r["doc_id"]: r for r in queries.op1_toxicity(spark, sf).collect()}
    assert set(got) == set(held) and all(got[i]["held_out"] == h and got[i]["predicted"] == int(got[i]["score"] >= 0.7) for i, h in held.items())
    learn = [(i, t, y) for i, t, y in docs.join(labels, "doc_id").select("doc_id", "text", "toxic").collect() if not held[i]]
    model = toxicity.fit(spark.createDataFrame(learn, "doc_id long, text string, toxic int"))
    assert (model.odds > 0).any() and model.drift < 0
    for r in docs.where("n_chars < 6000").collect():
        assert got[r["doc_id"]]["score"] == pytest.approx(brute_score(model, r["text"]), abs=1e-9)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert not [i for i, y in truth.items() if held[i] and y == 0 and got[i]["predicted"]][2:]


def test_toxicity_scores_do_not_depend_on_held_out_labels(spark, tmp_path):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flip = F.when(queries.held_out(3, 1), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    spark.read.parquet(f"{SF}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("toxic", flip).write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(map(tuple, queries.op1_toxicity(spark, str(tmp_path)).collect())) == sorted(map(tuple, queries.op1_toxicity(spark, SF).collect()))


# --- language ------------------------------------------------------------------------------------


def brute_language(model, text):
    """Language and share of a text by its n-grams one at a time, in exact order of the definition."""
    clean = " " + "".join(c if c > "\x7f" or c.isascii() and c.isalpha() else " " for c in re.sub("[A-Z]", lambda m: m[0].lower(), text)) + " "
    data = re.sub(" +", " ", clean).encode() + b"    "
    n, sums = len(data) - 4, np.zeros(len(model.weights))
    for at in range(n):
        h = (data[at] + 1) * int(langid._MULTIPLY[0]) % (1 << 32)
        for k in range(1, max(langid.ORDERS)):
            h = (h ^ ((data[at + k] + 1) * int(langid._MULTIPLY[k % 4]) % (1 << 32))) * 0x01000193 % (1 << 32)
            if k + 1 in langid.ORDERS:
                sums += model.weights[:, langid.ORDERS.index(k + 1), h >> (32 - langid.BITS)]
    margin = sums / (len(langid.ORDERS) * math.sqrt(n + 8))
    losses = [sum(w * math.log1p(math.exp(-c * m)) for c, m, w in zip(code, margin, model.trust)) for code in model.code]
    shares = np.exp(-8 * (np.array(losses) - min(losses)))
    return model.languages[int(np.argmin(losses))], float((shares / shares.sum()).max())


def test_language_query_agrees_with_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where(~queries.held_out(5, 0)))
    got = {r["doc_id"]: r for r in queries.op5_langid(spark, SF).collect()}
    for r in docs.collect():
        want = brute_language(model, r["text"]) if r["text"] and any(unicodedata.category(c)[0] == "L" for c in r["text"]) else ("und", 0.0)
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert got[r["doc_id"]]["lang_pred"] == want[0] and got[r["doc_id"]]["score"] == pytest.approx(want[1], abs=1e-3)


def test_language_needs_a_letter_and_does_not_depend_on_cuts(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    odd = [(1, "½ ² Ⅷ"), (2, "١٢٣ 45"), (3, "ª"), (4, "中文"), (5, "_ - _"), (6, None)]
    got = {r["doc_id"]: r["__lang"] for r in langid.predict(spark.createDataFrame(odd, "doc_id long, text string"), model, ["doc_id"]).collect()}
    assert [i for i, x in got.items() if x == "und"] == [1, 2, 5, 6]
    with pytest.raises(ValueError):
        langid.predict(docs.withColumn("__lang", F.lit(1)), model, ["doc_id", "__lang"])
    text = " ".join(r["text"] or "" for r in docs.limit(30).collect()).encode()
    whole = sum(model.sums(p, n) for _, p, n in langid._blocks([text]))
    monkeypatch.setattr(langid, "BLOCK_BYTES", 1000)
    assert len(list(langid._blocks([text]))) > 10 and np.allclose(sum(model.sums(p, n) for _, p, n in langid._blocks([text])), whole, rtol=1e-4)


# --- packing -------------------------------------------------------------------------------------


def test_ids_of_all_letters_before_stops():
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(packing.vocabulary_path()), packing.word_ids(packing.vocabulary_path())
    letters = [chr(i) for i in range(0x30000) if unicodedata.category(chr(i))[0] == "L"]
    words = [f"a{x}{stop}" for x in letters for stop in (".", ",", "")] + ["İ.", "İ,", "Bİ.", "aक़.", "don't.", "A1b.", "é.", "ﬁ,"]
    for word, found in zip(words, tokenizer.encode_batch(words, add_special_tokens=False)):
        assert np.frombuffer(own._ids(word.encode()), "<u4").tolist() == found.ids


# --- secrets -------------------------------------------------------------------------------------


def test_two_versions_of_a_table_share_a_ledger(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    schema = "doc_id long, text string"
    first = spark.createDataFrame([(1, "token=abcdef"), (2, "clean"), (3, None), (4, "clean")], schema)
    second = spark.createDataFrame([(1, "token=abcdef"), (2, "clean again"), (3, ""), (4, "clean")], schema)
    a = sorted(map(tuple, secrets.digest(first, ledger=ledger).collect()))
    assert spark.read.parquet(ledger).count() == 3  # clean and empty blobs are recorded too
    b = sorted(map(tuple, secrets.digest(second, ledger=ledger).collect()))
    assert spark.read.parquet(ledger).count() == 4 and [x[:4] for x in a] == [x[:4] for x in b]
    spark.conf.set(secrets.LEDGER_SETTING, ledger)
    try:
        assert sorted(map(tuple, secrets.digest(second).collect())) == b and spark.read.parquet(ledger).count() == 4
    finally:
        spark.conf.unset(secrets.LEDGER_SETTING)


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, __blob string, __spans string, __text string, __lang string, __ambiguous string, __score string, __gone string, __kept string, __n string, __id string, __digest string, __hit string, __row string, __found string, __key string"


def test_columns_of_clashing_names_stay(spark):
    import corpus_pipeline

    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").limit(12).collect()]
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t), *[f"own{i}"] * 15) for i, t in enumerate([*texts, "token=abcdef", "", None or "x"])]
    rows.append((99, None, None, None, None, *["own99"] * 15))
    docs = spark.createDataFrame([*rows, rows[0]], CLASHING)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert all(r[c] == f"own{r['doc_id']}" for r in out.collect() for c in docs.columns[5:])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).where("start = 0").count() == len(rows) + 1
    with pytest.raises(ValueError):
        secrets.scan(docs)


def test_language_stage_takes_odd_rows(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900001, None, "en", "s", None), (900002, "", "en", "s", 0), (900003, "12 ½", "en", "s", 4), (None, docs.first()["text"], None, None, None)], docs.schema)
    out = corpus_pipeline.language(spark, docs.union(odd), SF)
    assert out.schema == docs.schema and out.where("doc_id > 900000").count() == 0 and out.where("doc_id is null").count() == 1
    assert out.where("doc_id < 900000").count() == docs.where("text rlike '[A-Za-z]'").count()
    assert corpus_pipeline.language(spark, docs.limit(0), SF).count() == 0


# --- WARC ----------------------------------------------------------------------------------------


def parse_warc(data: bytes):
    """A parser of its own: header lines up to the blank one, then as many bytes as announced."""
    f = io.BytesIO(data)
    while line := f.readline():
        if line == b"\r\n":
            continue
        assert line == b"WARC/1.1\r\n"
        fields = {}
        while (line := f.readline()) != b"\r\n":
            name, value = line.decode().split(":", 1)
            fields[name] = value.strip()
        yield fields, f.read(int(fields["Content-Length"]))


def sha1(data: bytes) -> str:
    import base64

    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_warc_query_by_another_parser(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op7_warc(spark, SF).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in rows) == sorted((i, k) for i in pages for k in ("conversion", "metadata"))
    for r in rows:
        ((fields, block),) = parse_warc(r["record"])
        page = pages[r["page_id"]]
        assert fields["WARC-Type"] == r["record_type"] and fields["WARC-Block-Digest"] == sha1(block) and fields["WARC-Target-URI"] == page["url"]
        assert "WARC-Payload-Digest" not in fields and r["source_payload_digest"] == sha1(page["html"].encode()) and sha1(page["html"].encode()) in r["record"].decode()
        if r["record_type"] == "conversion":
            text = block.decode()
            assert "<script" not in text and "<!--" not in text
            visible = re.sub(r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>|<[^>]*>", " ", page["html"])
            shown = lambda t: re.sub(r"\s+", "", __import__("html").unescape(t))
            assert shown(text) == shown(visible)


def test_archives_on_disk_keep_their_headers(spark, tmp_path):
    def response(n, body, head="HTTP/1.1 404 Not Found\r\nX-Own: yes\r\nContent-Type: text/html"):
        block = head.encode() + b"\r\n\r\n" + body
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{n}>\r\nWARC-Target-URI: http://a/{n}\r\nWARC-Date: 2024-02-0{n}T00:00:00Z\r\nWARC-Payload-Digest: {sha1(body)}\r\nX-Folded: a\r\n b\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:i>\r\nContent-Length: 4\r\n\r\nWARC\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(info + response(1, b"<p>one WARC/1.1</p>") + response(2, b""))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (info, response(3, b"<b>three</b>"), response(4, b"four"))))
    (tmp_path / "c.warc").write_bytes(response(5, b"five") + response(6, b"six")[:-9])
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(response(7, b"seven"))[:-12])
    (tmp_path / "e.warc").write_bytes(b"no archive at all")
    (tmp_path / "f.warc").write_bytes(b"")
    rows = warc.load(spark, f"file://{tmp_path}").collect()
    ok = {r["record_id"][10:-1] for r in rows if r["error"] is None}
    assert ok == {"i", "1", "2", "3", "4", "5"} and sorted(r["archive"].rsplit("/", 1)[1] for r in rows if r["error"]) == ["c.warc", "d.warc.gz", "e.warc"]
    made = warc.derivatives_of_records(warc.load(spark, f"file://{tmp_path}")).collect()
    assert len(made) == 10
    for r in made:
        ((fields, block),) = parse_warc(r["record"])
        n = r["source_id"][10:-1]
        assert fields["WARC-Refers-To"] == f"<urn:uuid:{n}>" and fields["WARC-Date"] == f"2024-02-0{n}T00:00:00Z" and fields["WARC-Target-URI"] == f"http://a/{n}"
        if r["record_type"] == "metadata":
            assert b"http-status: HTTP/1.1 404 Not Found\r\nhttp-X-Own: yes" in block
    assert {r["source_id"][10:-1]: parse_warc(r["record"]).__next__()[1] for r in made if r["record_type"] == "conversion"} == {"1": b"one WARC/1.1", "2": b"", "3": b"three", "4": b"four", "5": b"five"}


def test_text_of_pages_takes_linear_time():
    import time

    took = {}
    for k in (20_000, 200_000):
        began = time.process_time()
        for part in ("<script ", "<a ", "<!-- ", "<script>", "</", "<", "<p><"):
            warc.plain_text(part * k)
        took[k] = time.process_time() - began
    assert took[200_000] < 30 * took[20_000] + 1
    assert warc.plain_text("a < b <c") == "a < b <c" and warc.plain_text("x<!-- y") == "x" and warc.plain_text("<script>z") == "" and warc.plain_text("") == ""


# --- media ---------------------------------------------------------------------------------------


def test_packed_members_and_damaged_archives(spark, tmp_path):
    data = media.encode(media.payload_of(b"some text " * 200))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("stored.png", data, zipfile.ZIP_STORED)
        z.writestr("packed.png", data, zipfile.ZIP_DEFLATED)
        z.writestr("other.png", data, zipfile.ZIP_BZIP2)
    (tmp_path / "b.zip").write_bytes(b"PK\x03\x04 no directory")
    rows = {r["member"]: r for r in media.load(spark, f"file://{tmp_path}").collect()}
    assert set(rows) == {"stored.png", "packed.png", "other.png", None}
    assert bytes(rows["stored.png"]["media"]) == bytes(rows["packed.png"]["media"]) == data and rows["other.png"]["error"] and rows[None]["archive"] == "b.zip"


def test_archives_outside_the_manifest_are_not_read(spark):
    folder = media.store(spark.createDataFrame([(f"id/{i}", f"text {i}") for i in range(20)], "doc_id string, text string"))
    with zipfile.ZipFile(folder.removeprefix("file://") + "/late.zip", "w") as z:
        z.writestr("0_4_.png", media.encode(media.payload_of(b"late")))
    assert media.load(spark, folder).count() == 20
    got = media.features(spark.createDataFrame([("a/b", "x"), (None, "x"), ("ü", None)], "doc_id string, text string"))
    assert {r["doc_id"] for r in got.collect()} == {"a/b", None, "ü"}


# --- near duplicates -----------------------------------------------------------------------------


def test_ids_that_are_text(spark):
    rows = [("b", "one two three four five six"), ("a", "ONE two three four five six"), ("c", "other words"), (None, "other words"), ("d", None)]
    got = sorted(map(repr, map(tuple, neardup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect())))
    assert got == sorted(map(repr, [("b", 2, "a", False), ("a", 2, "a", True), ("c", 1, "c", True), (None, 1, None, True), ("d", 0, "d", True)]))


@pytest.mark.parametrize("name", ["op3_secrets", "op8_neardup", "op10_decontam"])
def test_queries_agree_with_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, "/root/testdata/sf0.01").select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_work_is_cleared_and_clusters_need_a_shared_folder(spark, monkeypatch):
    path = common.work_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert "/work/" + spark.sparkContext.applicationId in path and spark.read.parquet(path).count() == 3

    class Elsewhere:
        class sparkContext:
            master = "spark://far:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError):
        common.shared_dir(Elsewhere)


def test_texts_with_stops_after_any_letter():
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(packing.vocabulary_path()), packing.WordIds(packing.vocabulary_path(), keep=500)
    letters = [chr(i) for i in range(0x800) if unicodedata.category(chr(i))[0] == "L"]
    for lo in range(0, len(letters), 100):
        text = " ".join(f"a{x}. {x}, {x}., A{x}... {x}. b ×. {x}.b …, 'S. <{x}>." for x in letters[lo : lo + 100]) + " end."
        assert np.frombuffer(own.text(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(
    "tag, labels, permissive",
    [
        ("MIT AND (GPL-3.0 OR EUPL-1.2)", "eupl-1.2,gpl,mit", False), ("CC-BY-NC-4.0", "cc-by,cc-by-nc", False), ("CC-BY-4.0", "cc-by", True), ("CC-BY-ND-3.0 OR MIT", "cc-by,cc-by-nd,mit", True), ("MIT AND", "mit", None), ("MIT AND (GPL-3.0", "mit", None), ("(MIT OR Apache-2.0) AND", "apache,mit", None),
        ("MIT and so on", "mit", True), ("mitigation", "", None), ("GPLv2", "gpl", False), ("Apache-2.0 WITH LLVM-exception", "apache", True), ("MIT-0", "mit", True), ("bsdish", "", None),
    ],
)
def test_license_terms_that_are_cut_or_restricted(tag, labels, permissive):
    from scanlattice.llm import licenses

    got = licenses.scan_text(f"SPDX-License-Identifier: {tag}\n".encode(), licenses._automaton())
    assert (got["labels"], got["permissive"]) == (labels, permissive)
