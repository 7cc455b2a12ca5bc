"""The tree of elements against a plain stack."""

import re

import pytest

from fathom.operators import html_tree as h


def plain(html):
    html = re.sub(r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "", html)
    found = [(i, m[2].lower(), m[1] == "/") for i, m in enumerate(re.finditer(h.TAG, re.sub(h.DECLARATION, "", html)), 1)]
    starts, pair = {}, set()
    for pos, name, shut in found:
        if name in h.VOID:
            continue
        if not shut:
            starts.setdefault(name, []).append(pos)
        elif starts.get(name):
            pair |= {starts[name].pop(), pos}
    stack, out = [], []
    for pos, name, shut in found:
        if shut:
            if pos in pair:
                stack.pop()
            continue
        out.append((pos, name, len(stack), stack[-1] if stack else None, pos in pair))
        if pos in pair:
            stack.append(pos)
    return out


def got(spark, pages):
    out = {}
    for r in h.tree(pages).orderBy("page_id", "pos").collect():
        out.setdefault(r.page_id, []).append((r.pos, r.name, r.depth, r.parent, r.closed))
    return out


@pytest.mark.parametrize("sf", ["0.01"])
def test_all_pages_equal_a_plain_stack(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet")
    assert got(spark, pages) == {r.page_id: plain(r.html) for r in pages.collect()}


def test_odd_markup(spark):
    pages = [
        '<div><p>a<p>b</p></div></p><p>c', "<b><i>x</b>y</i>z<u>", "</x></x><x><x></x>", "plain < 5 > 4", "", None, '<a title="1 > 0" href=\'>\'>t</a>', "<DIV><Br/><IMG src=x><div></DIV></div>",
        "<ul>" * 30 + "<li>" + "</ul>" * 31, "<p><p><p></p></p></p></p><p>", "<!DOCTYPE html><!-- <p> --><script>'</p>'</script><p>x</p>",
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    assert got(spark, df) == {i: plain(p) for i, p in enumerate(pages) if p and plain(p)}
    texts = {(r.page_id, r.pos): r.text for r in h.tree(df).collect()}
    assert texts[0, 2] == "a" and texts[6, 1] == "t" and texts[10, 1] == "x"
