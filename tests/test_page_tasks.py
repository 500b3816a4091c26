"""Pages are parsed by all tasks, in bounded batches, and by whichever tokenizer fits."""

import random

import pytest
from merchloom.functions import dom
from merchloom.operators import pages
from merchloom.plans import shops

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"
PLAIN = ["<li>", "</li>", "<tr>", "</tr>", '<td class="a b">', "</td>", "<p>", "</p>", '<div id="x">', "</div>", "<br>", '<img src="/a.jpg">', "text ", "a > b", "<h1>", "</h1>", "\n", '<ul\nclass="t">', "</ul>"]
ODD = [*PLAIN, "<br/>", "&amp;", "&", "<", "<a href='x'>", "<input disabled>", "<script>", "</script>", "<!-- x -->", "<!doctype html>", '<A HREF="y">', "</A>", "<title>", "</title>", '<div a="b"c="d">', "</ p>"]


def tree(node):
    return [c if isinstance(c, str) else (c.tag, c.attrs, tree(c)) for c in node.children]


def test_both_tokenizers_build_the_same_tree():
    rng = random.Random(6)
    for k in range(3000):
        html = "".join(rng.choices(ODD if k % 2 else PLAIN, k=rng.randint(0, 14)))
        whole = dom._Builder()
        whole.feed(html)
        whole.close()
        assert tree(dom.parse(html)) == tree(whole.root)


def test_selectors_find_what_a_walk_finds():
    rng = random.Random(7)
    for _ in range(500):
        root = dom.parse("".join(rng.choices(ODD, k=20)))
        for node in [root, *root.walk()]:
            below, stack = [], [c for c in reversed(node.children) if isinstance(c, dom.Element)]
            while stack:
                below.append(stack.pop())
                stack.extend(c for c in reversed(below[-1].children) if isinstance(c, dom.Element))
            assert node.walk() == below
            for selector in ("li", "td.a, p", "#x", "#x .a", "tr > td", "[src]", "*"):
                found = [n for n in below if any(dom._matches(n, chain) for _, chain in dom._compiled(selector))]
                assert node.all(selector) == found and node.first(selector) == (found[0] if found else None)


@pytest.mark.parametrize("source", ["et_market", "in_heat"])
def test_cards_are_dealt_over_tasks(spark, source):
    made = shops.card_pages(spark, "/root/testdata/sf0.001", source)
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_batches_of_pages_are_bounded(spark):
    before = spark.conf.get(BOUND, None)
    spark.conf.unset(BOUND)
    try:
        block = '<div class="product-thumb"><div class="prod-name"><a href="/p-{}.html">x</a></div></div>'
        html = "".join(block.format(i) for i in range(700))
        made = pages.listings(spark.createDataFrame([(i, html) for i in range(10)], "page_id long, html string").coalesce(1), "et_market")
        assert int(spark.conf.get(BOUND)) <= 4 << 20
        assert made.count() == 7000
    finally:
        spark.conf.unset(BOUND) if before is None else spark.conf.set(BOUND, before)


def test_pages_with_json_are_dealt_over_tasks(spark, monkeypatch):
    seen = []
    found = pages.json_ld_products
    monkeypatch.setattr(pages, "json_ld_products", lambda made, *rest: seen.append(made) or found(made, *rest))
    shops.json_ld_products(spark, "/root/testdata/sf0.001")
    assert seen[0].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
