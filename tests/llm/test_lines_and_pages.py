import hashlib
from html.parser import HTMLParser

from loadtide.llm.line_dedup import drop_boilerplate, host_of
from loadtide.llm.warc import derivatives, derive, parse_http, plain_text, read_records, responses_from_pages, write_records


def test_lines_over_the_ratio_go_and_others_stay(spark):
    pages = [(i, "a", f"menu \nown {i}\n\nmenu") for i in range(5)] + [(10 + i, "a", f"text {i}\nrare") for i in range(3)]
    pages += [(20, "b", "menu\nown"), (21, None, "menu"), (22, "a", None), (23, "a", ""), (24, "a", "menu")]
    df = spark.createDataFrame([(*p, 7, 8) for p in pages], "doc_id long, source string, text string, _salt int, lines int")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in drop_boilerplate(df, ratio=0.5, least_pages=4, counted=True).collect()}
    assert got[0] == ("own 0\n", 4, 2)                               # the empty line stays
    assert got[10] == ("text 0\nrare", 2, 0) and got[20] == ("menu\nown", 2, 0)
    assert got[21] == ("menu", 1, 0) and got[22] == (None, 0, 0) and got[23] == ("", 1, 0) and got[24] == ("", 1, 1)
    assert drop_boilerplate(df).columns == df.columns


def test_copies_of_a_page_are_one_page(spark):
    df = spark.createDataFrame([(i, "a", "copied\nline") for i in range(50)] + [(100 + i, "a", f"x {i}") for i in range(10)], "doc_id long, source string, text string")
    assert {r["text"] for r in drop_boilerplate(df).filter("doc_id < 50").collect()} == {"copied\nline"}
    assert drop_boilerplate(df.limit(0)).count() == 0


def test_host(spark):
    df = spark.createDataFrame([("http://WWW.A.example/x?y",), ("https://b.example:8/",), (None,)], "u string")
    assert [r[0] for r in df.select(host_of(df.u)).collect()] == ["a.example", "b.example", None]


class Plain(HTMLParser):
    """Text nodes outside script and style, by the library's parser."""

    def __init__(self):
        super().__init__()
        self.skip, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "head")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_plain_text_equals_the_parser_on_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for p in pages:
        parser = Plain()
        parser.feed(p["html"])
        assert "".join(plain_text(p["html"]).split()) == "".join("".join(parser.out).split()), p["page_id"]


def test_plain_text_of_odd_pages():
    assert plain_text("") == ""
    assert plain_text("<p>a<br/>b &lt;c&gt;&nbsp;d</p><header>h</header><!-- x") == "a\nb <c> d\nh"
    assert plain_text("<script>if (a < b) '</p>'</script>t<style>p{}") == "t"
    assert plain_text("1 < 2 and <a title='x>y'>z</a>") == "1 < 2 and z"


def test_an_unclosed_head_and_a_self_closing_svg_end():
    assert plain_text("<head><title>T</title><body><p>text</p>") == "text"
    assert plain_text("<html><head lang=x><!-- <p> --><meta charset='>'><script>'<p>'</script>\n<link href=a><p>text</p><p>more") == "text\nmore"
    assert plain_text("<head><title>T</title>loose</head><header>h</header>") == "loose\nh" and plain_text("<head><style>a</style></head>t") == "t"
    assert plain_text("a<svg class='x>y' /><p>b</p><svg><path d='M0'/><text>no</text></svg>c<svg/>d") == "a\nb\nc d"
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<head><title>T</title><body><svg/><a href='/q'>z</a>"
    meta, text = derive("<r>", "u", "d", page, None)
    assert "outlink: /q\r\n" in meta[-1] and text[-1] == "T\nz"


def sha1(b):
    import base64
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_records_refer_to_their_response(spark):
    http = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=latin-1\r\nX-A: b: c\r\n\r\n<title>T&amp;</title><a href='/q'>\xe9</a>"
    rows = [("<r1>", "http://a/", "d", http, None), ("<r2>", None, None, None, "sha1:KNOWN"), (None, "u", "d", http, None), ("<r3>", "u", "d", b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "record_id string, target_uri string, date string, block binary, payload_digest string, content string")
    got = {(r["refers_to"], r["warc_type"]): r for r in derivatives(df).collect()}
    assert set(got) == {("<r1>", "metadata"), ("<r1>", "conversion"), ("<r2>", "metadata"), ("<r2>", "conversion"), ("<r3>", "metadata")}
    meta, text = got["<r1>", "metadata"], got["<r1>", "conversion"]
    assert text["content"] == "T&\né" and text["target_uri"] == "http://a/"
    assert meta["payload_digest"] == text["payload_digest"] == sha1(parse_http(http)[2])
    assert text["block_digest"] == sha1(text["content"].encode())
    assert "http-header-x-a: b: c\r\n" in meta["content"] and "outlink: /q\r\n" in meta["content"] and f"conversion: {text['record_id']}\r\n" in meta["content"]
    assert got["<r2>", "conversion"]["content"] == "" and got["<r2>", "metadata"]["payload_digest"] == "sha1:KNOWN"
    assert derivatives(df.limit(0)).count() == 0


def test_archive_round_trip(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    records = derivatives(responses_from_pages(pages, "2024-01-01T00:00:00Z"))
    assert records.count() == 2 * pages.count() == records.select("record_id").distinct().count()
    write_records(records, str(tmp_path / "w"))
    back = read_records(spark, str(tmp_path / "w"))
    assert back.filter("complete").count() == records.count()
    assert back.select(*records.columns).exceptAll(records).count() == 0
