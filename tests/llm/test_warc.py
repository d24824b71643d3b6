import hashlib

from firegrid.llm import warc
from firegrid.llm.common import Scratch

PAGES = "page_id long, url string, html string, digest string, same int, bytes long"


def page(page_id, url, html):
    return (page_id, url, html, "clash", 1, 2)


def frame(spark, rows):
    return spark.createDataFrame(rows, PAGES).repartition(4)


BIG = "<p>\r\n\r\nWARC/1.1\r\n\r\n" + "ä" * 700


def rows():
    out = [page(1, "http://B.example.org/x?q=1#f", BIG), page(2, "http://b.example.org/x?q=1", BIG), page(7, "https://a.example.org/", BIG)]
    out += [page(3, None, None), page(4, "http://c.d/\r\ne", ""), page(5, "u", "small"), page(6, "u", "small"), page(None, "n", BIG)]
    out += [page(8, "http://z/", "z" * 1000)] * 2 + [page(9, "http://z/", "z" * 999), page(10, "http://z/", "z" * 999)]
    return out + [page(100 + i, "http://hot/", f"{i} " + "y" * 1200) for i in range(60)]


def test_round_trip(spark):
    got = warc.archive_pages(frame(spark, rows()), archive_bytes=20_000).collect()
    assert len(got) == len(rows())
    best = {}
    for i, _, html, *_ in rows():
        if i is not None and html and len(html.encode()) >= 1000:
            best[html] = max(best.get(html, -1), i)
    expected = []
    for i, url, html, *_ in rows():
        body = (html or "").encode()
        refers = best.get(html) if len(body) >= 1000 and best.get(html) != i else None
        expected.append((i, len(body), hashlib.sha1(body).hexdigest(), "response" if refers is None else "revisit", refers))
    assert sorted(map(str, expected)) == sorted(
        str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got
    )


def test_history_is_in_order_over_runs(spark):
    path = Scratch(spark).path("warc")
    warc.write_archives(frame(spark, rows()), path, archive_bytes=10_000, compression="none")
    records = warc.read_archives(spark, path)
    assert records.select("archive").distinct().count() > 3
    got = sorted(warc.capture_history(records, range_rows=20).collect(), key=lambda r: (r["history_range"], r["history_place"]))
    keys = [(r["url_key"], r["captured"]) for r in got]
    assert keys == sorted(keys) and len({r["history_range"] for r in got}) > 2
    assert {r["url_key"] for r in got} >= {"org,example,b)/x?q=1", ")", "hot)/"}


def test_loser_tree():
    import random

    draw = random.Random(5)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((draw.randint(0, 20),) for _ in range(draw.randint(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_empty(spark):
    assert warc.archive_pages(frame(spark, [])).count() == 0
