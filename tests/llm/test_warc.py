"""Archives against a plain grouping of payloads, and the merged index against sorting."""
import base64
import gzip
import hashlib
import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.llm import warc
from framelake.llm.queries import op3_warc


def brute(pages):
    groups = defaultdict(list)
    for p, h in pages:
        groups[h or ""].append(p)
    out = []
    for p, h in pages:
        b = (h or "").encode()
        ids = [x for x in groups[h or ""] if x is not None]
        top = max(ids, default=None)
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if p == top else "revisit", None if p == top else top))
    return sorted(out, key=str)


def digest(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_op3(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = op3_warc(spark, sf)
    assert digest(out) == brute([(r.page_id, r.html) for r in pages.collect()])
    index = warc.archive_and_index(pages).collect()
    keys = [(r.url_key, r.captured, r.page_id) for r in index]
    assert len(keys) == pages.count() and keys == sorted(keys)


ODD = [(1, None, None), (2, "http://a.org/x", ""), (3, "http://a.org/x", "same"), (4, "http://a.org/y\r\nWARC-Type: evil", "same"), (5, "", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"),
       (6, "http://É.org/", "é漢\U0001F9D1\r\n\r\n"), (6, "http://É.org/", "é漢\U0001F9D1\r\n\r\n"), (None, "http://a.org/x", "same"), (None, None, "alone"), (None, None, "alone"),
       (7, "x", "long " * 300_000), (8, "x", "long " * 300_000), (9, "http://a.org/x", "same "), (-1, "http://a.org/x", "same")]


def test_odd(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "x", 1) for r in ODD], "page_id long, url string, html string, _bytes string, file int")
    folder = f"file://{tmp_path}/archives"
    out = warc.archive_and_index(pages, folder)
    assert digest(out) == brute([(p, h) for p, _, h in ODD])
    raw = [gzip.open(f).read() for f in (tmp_path / "archives").glob("*.gz")]
    assert sum(len(list(warc.records(__import__("io").BytesIO(r)))) for r in raw) == len(ODD)
    for r in out.collect():                                   # positions lead to the record
        one = next(gzip.open(f).read() for f in (tmp_path / "archives").glob("*.gz") if f.name == r.file)
        assert one[r.position:].startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())
    assert digest(warc.archive_and_index(pages.limit(0))) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50)), max_size=9))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc.LoserTree([[(x,) for x in r] for r in runs], lambda r: r)) == sorted((x,) for r in runs for x in r)


def test_merge(spark):
    rng = random.Random(4)
    rows = [(f"k{rng.choice([0, 0, 0, 1, 2, 3])}", f"t{rng.randrange(9)}", i, None, 0, "d", "response", None, f"f{i % 17}", i) for i in range(2000)]
    out = warc.merge_histories(spark.createDataFrame(rows, warc.CAPTURE).repartition(5)).collect()
    assert [(r.url_key, r.captured, r.page_id) for r in out] == sorted((r[0], r[1], r[2]) for r in rows)


def test_url_key():
    assert warc.url_key("http://www.A.org/x?q") == "org,a,www)/x?q" and warc.url_key(None) == "" and warc.url_key("no") == "no"
