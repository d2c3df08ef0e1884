"""Per-page HTML helper (H8, H12, H14): one streaming parse per page.

Spark has no HTML tree functions, so this is the one place where page bodies
visit a Python worker.  It is a small ``html.parser`` subclass run inside an
Arrow-batched pandas UDF: one pass per page, no per-row UDF, and it only
collects raw strings -- cleaning, joining, precedence and URL resolution are
done afterwards with built-in column functions.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())

PAGE_PARTS = T.StructType([
    T.StructField("fields", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("fallback_title", T.StringType()),
    T.StructField("attachment", T.StringType()),
    T.StructField("hrefs", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
])


class _PageScan(HTMLParser):
    """Collects the texts of value elements (class ``value_class``) inside an
    element whose id is ``id_prefix + field``; the text of the first title
    candidate in document order; the hrefs of all links, and the first that contains a token."""

    def __init__(self, id_prefix, value_class, title_tags, link_token):
        super().__init__(convert_charrefs=True)
        self.id_prefix, self.value_class = id_prefix, value_class
        self.title_tags, self.link_token = title_tags, link_token
        self.stack = []          # (tag, field-or-None, capture-slot-or-None)
        self.fields = {}
        self.title = None
        self.title_depth = None
        self.title_buf = []
        self.attachment = None
        self.hrefs = []

    def _field_scope(self):
        for _, field, _ in reversed(self.stack):
            if field is not None:
                return field
        return None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        href = a.get("href") if tag == "a" else None
        if href is not None:
            self.hrefs.append(href)
            if self.attachment is None and self.link_token is not None and self.link_token in href:
                self.attachment = href
        if tag in VOID_TAGS:
            return
        field = None
        el_id = a.get("id") or ""
        if el_id.startswith(self.id_prefix):
            field = el_id[len(self.id_prefix):]
        slot = None
        classes = (a.get("class") or "").split()
        scope = self._field_scope()
        if scope is not None and self.value_class in classes:
            slot = []
            self.fields.setdefault(scope, []).append(slot)
        self.stack.append((tag, field, slot))
        if self.title is None and self.title_depth is None and self._is_title(tag, classes):
            self.title_depth = len(self.stack)

    def _is_title(self, tag, classes):
        for sel in self.title_tags:
            name, _, cls = sel.partition(".")
            if tag == name and (not cls or cls in classes):
                return True
        return False

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if self.title_depth is not None and self.title_depth > i:
                    self.title = "".join(self.title_buf)
                    self.title_depth = None
                del self.stack[i:]
                return

    def handle_data(self, data):
        for _, _, slot in self.stack:
            if slot is not None:
                slot.append(data)
        if self.title_depth is not None:
            self.title_buf.append(data)

    def result(self):
        if self.title_depth is not None:           # unclosed title candidate
            self.title = "".join(self.title_buf)
        fields = {k: ["".join(s) for s in v] for k, v in self.fields.items()}
        return {"fields": fields, "fallback_title": self.title, "attachment": self.attachment,
                "hrefs": self.hrefs, "error": None}


def scan_page(html: str | None, id_prefix: str, value_class: str, title_tags, link_token):
    if html is None:
        return None
    p = _PageScan(id_prefix, value_class, list(title_tags), link_token)
    error = None
    try:
        p.feed(html)
        p.close()
    except Exception as e:  # noqa: BLE001 - markup that breaks the parser is reported with what was read
        error = f"{type(e).__name__}: {e}"
    return p.result() | {"error": error}


def page_parts(html_col, id_prefix: str, value_class: str, title_tags, link_token):
    """Column of ``PAGE_PARTS`` structs (Arrow-batched)."""
    tags = tuple(title_tags)

    @F.pandas_udf(PAGE_PARTS)
    def _scan(s: pd.Series) -> pd.DataFrame:
        none = dict.fromkeys(PAGE_PARTS.names)
        rows = [scan_page(h, id_prefix, value_class, tags, link_token) or none for h in s]
        return pd.DataFrame({name: [r[name] for r in rows] for name in PAGE_PARTS.names})

    return _scan(html_col)
