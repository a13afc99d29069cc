"""Replay of retained files: right ones pass, every tampering has its own row."""

import copy
import hashlib

import pytest

from quillstone.functions.canonical import ledger_json
from quillstone.sources.replay import LIMITS, read_files, replay, verify_artifacts

from .test_verbs import event, ledger

sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()
PAGE = b"<html><h1>T</h1><p>a  b</p></html>"
BLOCKS = [{"id": "B-0001", "kind": "heading", "section": "T", "text": "T", "lossy": True}, {"id": "B-0002", "kind": "paragraph", "section": "T", "text": "a b", "lossy": True}]


def fetch(event_id, path, raw, media, extractor, text, blocks, local=True):
    limits = [LIMITS[extractor]] if extractor in LIMITS else []
    ir = {"text": text, "blocks": blocks, "extractor": extractor, "limitations": limits, "needs_host_extraction": extractor.startswith("pdf"), "normalization": "NFC-whitespace-v1"}
    digest = sha(ledger_json(ir))
    url = None if local else "https://x.org/a"
    receipt = {"artifact": path, "raw_sha256": sha(raw), "bytes": len(raw), "content_type": media, "http_status": 200, "generated_by": "g", "provider": "local" if local else "public_url", "url": "local:artifact" if local else url, "request": {"operation": "fetch"}}
    return event(
        "source.fetch", event_id, id="SRC-" + sha(raw)[:16], source_url=url, media_type=media, receipt=receipt, raw_sha256=sha(raw), text_sha256=sha(" ".join(text.split())), ir_sha256=digest, ir_path=f"sources/{digest}.ir.json",
        extractor=extractor, normalization="NFC-whitespace-v1", block_count=len(blocks), needs_host_review=True, needs_host_extraction=ir["needs_host_extraction"], limitations=limits,
    )


TEXT = "plain é\ntext"
HTML = fetch("f1", "raw/a.html", PAGE, "text/html", "html-stdlib-v1", "T\n\na b", BLOCKS, local=False)
NOTE = fetch("f2", "raw/b.txt", TEXT.encode(), "text/plain", "text-utf8-v1", TEXT, [{"id": "B-0001", "kind": "text", "section": "unknown", "text": TEXT, "lossy": False}])
PDF = fetch("f3", "raw/c.pdf", b"%PDF-1\xff", "application/pdf", "pdf-unextracted-v1", "", [])
ANCHOR = event("evidence.anchor", "a1", id="E", source=HTML["data"]["id"], source_event="f1", source_ir_sha256=HTML["data"]["ir_sha256"], block_id="B-0002", section="T", lossy=True)
SEARCH = event("search.result", "s1", status="failed")
GOOD = [HTML, NOTE, PDF, ANCHOR, SEARCH]
FILES = {"raw/a.html": PAGE, "raw/b.txt": TEXT.encode(), "raw/c.pdf": b"%PDF-1\xff"}


def tampered(at, **data):
    own = copy.deepcopy(GOOD)
    for path, value in data.items():
        to = own[at]["data"]
        *up, last = path.split("__")
        for k in up:
            to = to[k]
        to[last] = value
    return own


#: name: (events, files, fields that differ)
CASES = {
    "good": (GOOD, FILES, set()),
    "bytes": (GOOD, FILES | {"raw/b.txt": TEXT.encode() + b"!"}, {("f2", f) for f in ("receipt.raw_sha256", "receipt.bytes", "ir_sha256", "ir_path", "text_sha256")}),
    "missing": (GOOD, {k: v for k, v in FILES.items() if k != "raw/c.pdf"}, {("f3", "receipt.artifact")}),
    "size": (tampered(0, receipt__bytes=1), FILES, {("f1", "receipt.bytes")}),
    "hash": (tampered(0, receipt__raw_sha256="0" * 64, raw_sha256="0" * 64, id="SRC-" + "0" * 16), FILES, {("f1", "receipt.raw_sha256"), ("a1", "source")}),
    "blocks": (tampered(0, block_count=3), FILES, {("f1", "block_count")}),
    "text": (tampered(1, text_sha256="x"), FILES, {("f2", "text_sha256")}),
    "ir": (tampered(1, ir_sha256="x"), FILES, {("f2", "ir_sha256")}),
    "media": (tampered(1, media_type="text/html"), FILES, {("f2", f) for f in ("media_type", "extractor", "ir_sha256", "ir_path", "limitations")}),
    "limits": (tampered(2, limitations=[], needs_host_extraction=False, needs_host_review=False), FILES, {("f3", "limitations"), ("f3", "needs_host_extraction"), ("f3", "needs_host_review")}),
    "url": (tampered(0, source_url="https://y.org/"), FILES, {("f1", "source_url")}),
    "status": (tampered(0, receipt__http_status=404), FILES, {("f1", "receipt.http_status")}),
    "generator": (tampered(0, receipt__generated_by="h"), FILES, {("f1", "receipt.generated_by")}),
    "escape": (tampered(1, receipt__artifact="../good/raw/b.txt"), FILES, {("f2", "receipt.artifact")}),
    "none": (tampered(1, receipt=None), FILES, {("f2", "receipt")}),
    "search": ([*GOOD[:4], event("search.result", "s1", status="partial")], FILES, {("s1", "receipt")}),
    "anchor": (tampered(3, source_ir_sha256="x", section="U"), FILES, {("a1", "source_ir_sha256"), ("a1", "section")}),
    "block": (tampered(3, block_id="B-0009"), FILES, {("a1", "block_id"), ("a1", "section"), ("a1", "lossy")}),
    "source": (tampered(3, source_event="f9"), FILES, {("a1", "source_event")}),
    "not text": (GOOD, FILES | {"raw/b.txt": b"\xff\xfe"}, {("f2", "receipt.raw_sha256"), ("f2", "receipt.bytes"), ("f2", "media_type")}),
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    from pyspark.sql import functions as F

    root = tmp_path_factory.mktemp("store")
    rows = None
    for name, (events, files, _) in CASES.items():
        own = ledger(spark, events).withColumn("project", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
        for path, raw in files.items():
            (root / name / path).parent.mkdir(parents=True, exist_ok=True)
            (root / name / path).write_bytes(raw)
    files = read_files(spark, str(root))
    wrong = {n: set() for n in CASES}
    for r in replay(rows, files, "g").collect():
        wrong[r.project].add((r.event_id, r.field))
    return wrong, {r.project: r for r in verify_artifacts(rows, files, "g").collect()}


@pytest.mark.parametrize("name", CASES)
def test_differences(found, name):
    assert found[0][name] == CASES[name][2]
    assert found[1][name].artifacts_valid == (not CASES[name][2]) and found[1][name].n_errors == len(CASES[name][2])


def test_verified_receipts_are_counted(found):
    assert {n: found[1][n].receipts_verified for n in ("good", "bytes", "missing", "none", "blocks")} == {"good": 3, "bytes": 2, "missing": 2, "none": 2, "blocks": 3}


def test_extractions_are_never_broadcast(spark, monkeypatch):
    """They are as large as the files, which no estimate before they are made tells."""
    from pyspark.sql import functions as F

    from quillstone.sources import replay as module

    plans, real = {}, module.stored
    monkeypatch.setattr(module, "stored", lambda df, tag: plans.setdefault(tag, df) and real(df, tag))
    files = spark.createDataFrame([("p", k, bytearray(v)) for k, v in FILES.items()], "project string, path string, content binary")
    assert replay(ledger(spark, GOOD).withColumn("project", F.lit("p")), files).count() == 0
    shown = {tag: plans[tag]._jdf.queryExecution().sparkPlan().toString() for tag in ("extracted", "fetches")}
    assert all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in shown.values()), shown
