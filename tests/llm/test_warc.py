"""WARC derivatives: links, digests and headers, text against plain Python, files read back."""

import base64
import glob
import hashlib
import html
import re

from scoremill.llm import warc


def digest(text):
    return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def plain(payload):
    t = re.sub(warc.HIDDEN.replace(r"\z", r"\Z"), "", payload)
    t = html.unescape(re.sub(warc.TAG, "", re.sub(warc.BREAKING, "\n", t)))
    t = re.sub(r" ?\n[ \n]*", "\n", re.sub("[ \t\x0b\f\r ]+", " ", t))
    return t.strip(" \n")


PAGES = [
    (1, "http://a/x", "<html><head><title>T &amp; U</title><style>p{}</style></head><body><p>One  <b>two</b>\n three<br>four</p>"),
    (2, "http://a/y", "<script>var t='</p>';</script> no end <!-- c --> x &lt;b&gt; &#233;&nbsp;&copy; &am"),
    (3, None, None),
    (3, None, None),
    (None, "", ""),
    (5, "u", "<p>" + "word " * 100000 + "<!-- open"),
    (6, "u", "a < b and <1> <svg><p>drawn</p></svg>ü😀"),
]


def records_of(spark):
    return warc.derive(warc.responses(spark.createDataFrame(PAGES, "page_id long, url string, html string")))


def test_records(spark):
    sources = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    responses = {r["record_id"]: r for r in warc.responses(sources).collect()}
    assert len(responses) == len(PAGES) - 1
    out = records_of(spark).collect()
    assert len(out) == 2 * len(PAGES)
    by_id = {r["record_id"]: r for r in out}
    for r in out:
        source = responses[r["refers_to"]]
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", r["record_id"])
        assert r["block_digest"] == digest(r["block"]) and r["content_length"] == len(r["block"].encode())
        assert r["source_digest"] == source["payload_digest"] == digest(source["payload"])
        assert (r["target_uri"], r["date"], r["page_id"]) == (source["target_uri"], source["date"], source["page_id"])
        if r["warc_type"] == "conversion":
            assert r["block"] == plain(source["payload"])
            continue
        fields = [tuple(x.split(": ", 1)) for x in r["block"].split("\r\n")[:-1]]
        single = dict(f for f in fields if f[0] != "source-http-header")
        assert single["source-record-id"] == r["refers_to"]
        assert single["source-block-digest"] == digest(f"{source['http_headers']}\r\n{source['payload']}")
        assert single["source-http-status"] == "HTTP/1.1 200 OK"
        conversion = by_id[single["conversion-record-id"]]
        assert conversion["block_digest"] == single["conversion-block-digest"]
        kept = [v for n, v in fields if n == "source-http-header"]
        assert kept == source["http_headers"].split("\r\n")[1:-1]


def test_other_types(spark):
    sources = warc.responses(spark.createDataFrame(PAGES[:1], "page_id long, url string, html string"))
    head = "HTTP/1.1 200 OK\r\nContent-Type: {}\r\nX-A: b\r\n"
    plain_type = sources.withColumn("http_headers", warc.F.lit(head.format("text/plain")))
    image = sources.withColumn("http_headers", warc.F.lit(head.format("image/png")))
    no_head = sources.withColumn("http_headers", warc.F.lit(None).cast("string"))
    assert warc.derive(plain_type).where("warc_type = 'conversion'").first()["block"] == PAGES[0][2]
    only = warc.derive(image).collect()
    assert [r["warc_type"] for r in only] == ["metadata"] and "conversion-record-id: none" in only[0]["block"]
    assert warc.derive(no_head).count() == 2
    assert warc.derive(sources.where("page_id < 0")).count() == 0


def test_files_read_back(spark, tmp_path):
    records = records_of(spark)
    warc.write(records, str(tmp_path / "out"), "none")
    found = []
    for path in glob.glob(str(tmp_path / "out" / "part-*")):
        data = open(path, "rb").read()
        while data:
            head, data = data.split(b"\r\n\r\n", 1)
            version, *lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            n = int(fields["Content-Length"])
            block, data = data[:n].decode(), data[n:]
            assert version == "WARC/1.1" and data[:4] == b"\r\n\r\n"
            data = data[4:]
            found.append((fields["WARC-Type"], fields["WARC-Record-ID"], fields["WARC-Refers-To"], block))
    wanted = [(r["warc_type"], r["record_id"], r["refers_to"], r["block"]) for r in records.collect()]
    assert sorted(found) == sorted(wanted)


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = {r["page_id"]: r["html"] for r in pages.collect()}
    out = warc.derive(warc.responses(pages)).where("warc_type = 'conversion'").collect()
    assert {r["page_id"]: r["block"] for r in out} == {i: plain(t) for i, t in texts.items()}


def test_custom_elements_and_empty_svg(spark):
    pages = {
        1: "<p>a <svg-icon name='x'></svg-icon>b</p><p>c</p>",
        2: "<p>a <svg viewBox='0 0 1 1' />b<svg/>c</p><svg\nwidth='1'\n/>d",
        3: "<template-card>a</template-card> <style-guide>b</style-guide> c",
        4: "a<svg><path d='M0'/><text>drawn</text></svg>b<SCRIPT src='x/'>s</SCRIPT >c<style\n>t</style>d",
        5: "a<svg class='x'>drawn, never closed",
    }
    rows = spark.createDataFrame([(i, "u", t) for i, t in pages.items()], "page_id long, url string, html string")
    out = warc.derive(warc.responses(rows)).where("warc_type = 'conversion'").collect()
    assert {r["page_id"]: r["block"] for r in out} == {1: "a b\nc", 2: "a bc\nd", 3: "a b c", 4: "abcd", 5: "a"}
