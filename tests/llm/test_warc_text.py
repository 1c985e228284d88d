"""Character references, attribute quotes, ids and clashing names of WARC derivatives; text held against a parser."""

from html.parser import HTMLParser

from linkgraph.llm import warc

DATE = "2024-01-01T00:00:00Z"


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip, self.links = [], 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in warc.DROPPED
        self.parts.append("\n" if tag in warc.BLOCKS.split("|") else "")
        self.links += [v for k, v in attrs if tag == "a" and k == "href" and v]

    def handle_endtag(self, tag):
        self.skip -= tag in warc.DROPPED
        self.parts.append("\n" if tag in warc.BLOCKS.split("|") else "")

    def handle_data(self, data):
        self.parts.append("" if self.skip else data)


def test_text_and_links_against_a_parser(spark):
    pages = [
        "<html><head><title>Caf&eacute; &mdash; menu</title></head><body><p>&copy; 2024 &middot; A&amp;B &#8217;quoted&#x2019; &lt;b&gt;</p><a href=/un/quoted>one</a> <a class=x href='http://b/?a=1&amp;b=2'>two</a></body></html>",
        "<p>no &unknown; &amp;lt; reference &nbsp; here</p><script>x &copy;</script><a data-href='no' href=\"http://c\">three</a>",
        "<div>one<br>two</div><ul><li>&alpha;<li>&beta;</ul>",
    ]
    rows = warc.derive(warc.responses(spark.createDataFrame([(i, f"u{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string"), DATE)).collect()
    for i, page in enumerate(pages):
        own = {r.warc_type: r.content for r in rows if r.page_id == i}
        parser = Plain()
        parser.feed(page)
        assert own["conversion"].split() == "".join(parser.parts).replace("\xa0", " ").split()
        assert [x.removeprefix("outlink: ") for x in own["metadata"].split("\r\n") if x.startswith("outlink")] == parser.links
    assert "title: Café — menu" in next(r.content for r in rows if r.page_id == 0 and r.warc_type == "metadata")


def test_ids_clashes_long_and_empty_pages(spark):
    long = "<p>" + "word &amp; " * 40_000 + "</p>"
    pages = [(1, "u", "<p>a"), (1, "u", "<p>b"), (1, "u", "<p>b"), (None, "u", "<p>a"), (None, None, None), (2, "u", long)]
    frame = spark.createDataFrame([(*p, "k", "c", "r") for p in pages], "page_id long, url string, html string, id string, content string, record string")
    derived = warc.derivatives(frame)
    assert derived.count() == 12 and derived.select("record_id").distinct().count() == 10  # equal rows are one capture
    more = warc.derive(warc.responses(frame, DATE).selectExpr("*", "'k' AS id", "'c' AS content", "'r' AS record", "1 AS block_digest"))
    assert len(set(more.columns)) == len(more.columns) and {"_id", "_content", "_record", "_block_digest"} <= set(more.columns)
    assert {(r._id, r._content, r._record) for r in more.collect()} == {("k", "c", "r")}
    (text,) = [r.content for r in more.collect() if r.page_id == 2 and r.warc_type == "conversion"]
    assert text == ("word & " * 40_000).strip()
    assert warc.derivatives(frame.limit(0)).collect() == []
