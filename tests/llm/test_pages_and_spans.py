"""Personal data spans and the content-addressed archive, held against brute force."""

import base64
import hashlib
import random
import re
import time

import pytest
from cases import no_documents, odd_documents
from pyspark.sql import functions as F

from firmlens.llm import archive, pii
from firmlens.llm.queries import op9_pii, op10_archive

SF_DIR = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    back = [int(c) for c in reversed(digits)]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(back)) % 10 == 0


def confirmed(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [
        f"{kind}:{m.start()}:{m.end()}"
        for kind, pattern in PATTERNS.items()
        for m in re.finditer(pattern, text or "")
        if confirmed(kind, m.group())
    ]


def found_spans(row, kinds=pii.KINDS):
    return [f"{s.kind}:{s.start}:{s.end}" for k in kinds for s in row[k]]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rng = random.Random(3)
    alphabets = ["ab.@-%é ", "0123. -+()", "019 -.+@a", "aé😀@. 12", "45 -"]
    texts = [None, "", "a@b.cd%x@y.z", "x@y@z.w a@b.c@d.e", "1.2.3.4.5.6.7.8 999.1.1.1", "0001.002.3.4"]
    texts += ["é😀 4041894974608795 x", "+1 (234) 567-8901", "a@b.c " * 300, "1.1." * 400, "9" * 5000, "+1" + "(" * 500]
    for _ in range(1500):
        alphabet = rng.choice(alphabets)
        texts.append("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))))
    rows = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert found_spans(r) == base_spans(texts[r.doc_id]), texts[r.doc_id]


def test_very_long_runs_take_linear_time(spark):
    texts = ["a" * 300_000 + "@b.c", "9" * 200_000, "9." * 100_000, "A1" * 100_000]
    rows = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: len(found_spans(r)) for r in rows} == {0: 1, 1: 0, 2: 25_000, 3: 0}


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("pay to GB82 WEST 1234 5698 7654 32 please", ["iban"]),
        ("DE89370400440532013000", ["iban"]),
        ("DE88370400440532013000", []),
        ("my card 378282246310005", ["shortcard"]),
        ("number 378282246310005 alone", []),
        ("my card 378282246310006", []),
    ],
)
def test_added_kinds(spark, text, kinds):
    row = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [s.kind for k in pii.ADDED for s in row[k]] == kinds


def test_many_spans_take_linear_time(spark):
    """Four times the spans take some four times as long: no text is searched once per span."""
    seconds = []
    for n in (1000, 10_000, 40_000):
        docs = spark.createDataFrame([(1, "a@b.cd " * n)], "doc_id long, text string")
        start = time.perf_counter()
        assert pii.find_spans(docs).select(F.size("email").alias("n")).first().n == n
        seconds.append(time.perf_counter() - start)
    assert seconds[2] < 8 * max(seconds[1], 1)


def test_context_reaches_over_neighbouring_spans(spark):
    """The words around are those of the text, also where spans stand close to each other."""
    rng = random.Random(9)
    parts = ["a@b.cd", " ", "1.2.3.4", "4111111111111111", "card ", "+1 234 567 8901", "12", "host", "\n", "é", "bank ", "378282246310005", "x" * 30, ","]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 50))) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_spans(docs).collect():
        for kind in [*pii.KINDS, *pii.ADDED]:
            for s in r[kind]:
                reach = pii.CONTEXT_CHARS
                near = texts[r.doc_id][max(0, s.start - reach) : s.start] + " " + texts[r.doc_id][s.end : s.end + reach]
                raised = re.search(f"(?i){pii.CONTEXT[kind]}", near) is not None
                assert s.score == pytest.approx(pii.START[kind] + pii.NEARBY * raised)


def test_context_raises_the_score(spark):
    rows = [(1, "call me: +1 (234) 567-8901"), (2, "it is +1 (234) 567-8901")]
    found = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    scores = {r.doc_id: r.phone[0].score for r in found}
    assert scores[1] > scores[2]


def test_redacted_text(spark):
    rows = [(1, "mail a@b.cd, card 4041894974608795!"), (2, None), (3, "nothing")]
    found = pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in found} == {1: "mail <email>, card <card>!", 2: "", 3: "nothing"}


def test_spans_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = op9_pii(spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = base_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        for kind in pii.KINDS:
            assert r[f"n_{kind}"] == sum(s.startswith(kind + ":") for s in base)
        assert set(base) <= set(r.spans.split(",")) | {""}


def test_spans_of_odd_documents(spark):
    assert pii.find_spans(odd_documents(spark)).count() == 11
    assert pii.find_spans(no_documents(spark)).count() == 0


PAGES = "page_id long, url string, html string, header int, payload string"


def brute_archive(rows, least):
    firsts = {}
    for page_id, _, html, *_ in rows:
        firsts.setdefault(html or "", []).append(page_id)
    out = []
    for page_id, _, html, *_ in rows:
        body = (html or "").encode()
        ids = [i for i in firsts[html or ""] if i is not None]
        revisit = len(body) >= least and bool(ids) and page_id != min(ids)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page_id, len(body), digest, "revisit" if revisit else "response", min(ids) if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 1, 5])
def test_archive_round_trip(spark, tmp_path, least):
    rows = [
        (3, "u", "x"), (1, "u2", "x"), (1, "u2", "x"), (None, "n", "x"), (None, None, "zz"), (None, None, "zz"),
        (5, "e", None), (4, "e\r\nWARC-Type: fake", ""), (9, "ü", "é" * 9), (8, "ü", "é" * 9), (7, "l", "long" * 50_000),
    ]
    rows = [(*r, 1, "p") for r in rows]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    archive.write_archive(pages, str(tmp_path / "a"), least)
    records = archive.read_archive(spark, str(tmp_path / "a")).collect()
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records]
    assert sorted(found, key=repr) == brute_archive(rows, least)
    by_page = {p: (html or "").encode() for p, _, html, *_ in rows if p is not None}
    for r in records:
        if r.page_id is not None:
            assert bytes(r.payload) == by_page[r.page_id]
        assert bytes(r.header).startswith(b"WARC/1.1\r\n") and bytes(r.header).endswith(b"\r\n\r\n")
    stored = spark.read.parquet(str(tmp_path / "a" / "payloads"))
    assert stored.count() == len({html or "" for _, _, html, *_ in rows})


def test_damaged_payload_fails_the_read(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "one", 1, "p"), (2, "u", "two", 1, "p")], PAGES)
    archive.write_archive(pages, str(tmp_path / "a"))
    stored = spark.read.parquet(str(tmp_path / "a" / "payloads")).collect()
    broken = [(r.digest, r.payload_bytes, b"xxx" if i else bytes(r.payload)) for i, r in enumerate(stored)]
    spark.createDataFrame(broken, archive.PAYLOADS).write.mode("overwrite").parquet(str(tmp_path / "a" / "payloads"))
    with pytest.raises(Exception, match="lost or damaged"):
        archive.read_archive(spark, str(tmp_path / "a")).collect()


def test_archive_of_nothing(spark, tmp_path):
    archive.write_archive(spark.createDataFrame([], PAGES), str(tmp_path / "a"))
    assert archive.read_archive(spark, str(tmp_path / "a")).count() == 0


def test_archive_query(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()]
    found = [tuple(r) for r in op10_archive(spark, SF_DIR).collect()]
    assert sorted(found, key=repr) == brute_archive(rows, 0)
