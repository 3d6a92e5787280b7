"""Page text against the stdlib HTML parser, page by page."""

from riskscope import dictionaries as D
from riskscope.operators.pages import extract_pages
from riskscope.session import read_table

from conftest import SF_ORACLE

COLS = ["title", "meta_description", "text", "text_length", "low_content", "link_count"]


def _parse_html(html: str, dropped: frozenset, min_text_length: int) -> tuple:
    """One page with the stdlib tolerant parser: boilerplate subtrees
    skipped (nesting tracked), comments ignored, entities decoded."""
    from html.parser import HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.skip = []
            self.all, self.body = [], []
            self.in_body = self.saw_body = False
            self.title, self.in_title, self.title_bad, self.title_done = [], False, False, False
            self.meta_name = self.meta_prop = None
            self.links = 0

        def handle_starttag(self, tag, attrs):
            if self.skip:
                if tag == self.skip[-1]:
                    self.skip.append(tag)
                return
            if tag in dropped:
                self.skip.append(tag)
                return
            if self.in_title:
                self.title_bad = True
            a = dict(attrs)
            if tag == "body" and not self.saw_body:
                self.in_body = self.saw_body = True
            elif tag == "title" and not self.title_done:
                self.in_title = True
            elif tag == "meta":
                if self.meta_name is None and (a.get("name") or "").lower() == "description":
                    self.meta_name = a.get("content") or ""
                if self.meta_prop is None and a.get("property") == "og:description":
                    self.meta_prop = a.get("content") or ""
            elif tag == "a" and "href" in a:
                self.links += 1

        def handle_startendtag(self, tag, attrs):
            if not self.skip and tag not in dropped:
                self.handle_starttag(tag, attrs)
                if tag in ("title", "body"):
                    self.handle_endtag(tag)

        def handle_endtag(self, tag):
            if self.skip:
                if tag == self.skip[-1]:
                    self.skip.pop()
                return
            if tag == "body":
                self.in_body = False
            elif tag == "title" and self.in_title:
                self.in_title, self.title_done = False, True

        def handle_data(self, data):
            if self.skip:
                return
            self.all.append(data)
            if self.in_body:
                self.body.append(data)
            if self.in_title:
                self.title.append(data)

    p = P()
    p.feed(html or "")
    p.close()
    clean = lambda s: " ".join(s.split())
    pieces = p.body if p.saw_body else p.all
    text = clean(" ".join(x.strip() for x in pieces if x.strip()))
    title = "" if (p.title_bad or not p.title) else clean("".join(p.title))
    meta = p.meta_name if p.meta_name is not None else (p.meta_prop or "")
    return title, clean(meta), text, len(text), int(len(text) < min_text_length), p.links


def parsed(html):
    return _parse_html(html, frozenset(D.DROPPED_TAGS), D.LOW_CONTENT_CHARS)


def test_parser_handles_nesting():
    html = "<body><nav><nav>a</nav>b</nav>c &#8364; <div class='x>y'>d</div></body>"
    assert parsed(html)[2] == "c \u20ac d"


def test_page_text_equals_the_parser_on_all_pages(spark):
    pages = read_table(spark, SF_ORACLE, "pages").select("page_id", "html")
    got = {r.page_id: tuple(r[c] for c in COLS) for r in extract_pages(pages).select("page_id", *COLS).collect()}
    want = {r.page_id: parsed(r.html or "") for r in pages.collect()}
    assert len(want) == 250
    assert got == want
