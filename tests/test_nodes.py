"""The stack parser against a walk over trees of well-formed pages, and on pages that are not."""

import random
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from tidemark.sources import nodes


def tree(r, depth=0):
    tag = r.choice(["div", "div", "p", "ul", "span", "strong", "b", "blockquote", "section"]) if depth < 5 else "span"
    kids = [] if tag == "p" or depth > 4 else [tree(r, depth + 1) for _ in range(r.randint(0, 3))]
    kids = [f"<span>{r.choice(['x', 'y y', ' '])}</span>" if tag in ("strong", "b", "span") and ("<p" in k or "<div" in k or "<td" in k or "<blockquote" in k) else k for k in kids]
    if tag == "ul":
        kids = [f"<li>{k}</li>" for k in kids]
    text = "".join(f"{r.choice(['one', ' two ', '', 'three four', '<b>bold words</b>'])}{k}" for k in [*kids, ""])
    name = ' class="a field-content b"' if tag == "div" and r.random() < 0.3 else ""
    return f"<{tag}{name}>{text}</{tag}>"


def walked(html, whole):
    root = ET.fromstring(html)
    squeeze = lambda e: " ".join(" ".join(e.itertext()).split())
    found = [e for e in root.iter("div") if "field-content" in e.get("class", "").split()]
    if not found and not whole:
        return []
    top = max(found, key=lambda e: (len(squeeze(e)), -list(root.iter()).index(e))) if found else root
    out = []
    for e in top.iter():
        if e is top or e.tag not in nodes.BLOCKS or any(k is not e and k.tag in nodes.BLOCKS for k in e.iter()) or not squeeze(e):
            continue
        bold, todo = [], [(e, False)]
        while todo:
            k, heavy = todo.pop()
            heavy = heavy or k.tag in nodes.BOLD
            if heavy and k.text:
                bold.append(k.text)
            for c in k:
                todo.append((c, heavy))
                if heavy and c.tail:
                    bold.append(c.tail)
        n = len(" ".join(" ".join(bold).split()))
        out.append((squeeze(e), n > 0 and n >= 0.5 * len(squeeze(e))))
    return out


def test_blocks_against_a_walk_over_the_tree():
    r, some = random.Random(4), 0
    for _ in range(400):
        html = f"<body>{''.join(tree(r) for _ in range(3))}</body>"
        assert nodes.blocks_of(html, whole=True) == walked(html, True) and nodes.blocks_of(html) == walked(html, False)
        some += len(walked(html, True))
    assert some > 500


def test_pages_that_are_not_well_formed():
    page = '<div class="field-content"><p>One<p><b>TWO</b> x<ul><li>a<li>b</ul><script>var p = "<p>no</p>";</script><br><td>cell<th>&amp; &nbsp;head</div></b></i><p>outside'
    assert nodes.blocks_of(page) == [("One", False), ("TWO x", True), ("a", False), ("b", False), ("cell", False), ("& head", False)]
    assert nodes.blocks_of('<div class="field-content">short</div><div class="field-content"><div>longer text</div></div>') == [("longer text", False)]
    assert nodes.blocks_of("") == [] and nodes.blocks_of("<<>>< p <!-- <p>x</p> -->", whole=True) == [] and nodes.blocks_of("<p>x") == []
    deep = "<div>" * 3000 + "in" + "</div>" * 3000
    assert nodes.blocks_of(deep, whole=True) == [("in", False)]


def test_content_blocks_of_a_table(spark):
    df = spark.createDataFrame([(1, '<div class="field-content"><h2><b>HEAD</b></h2><p>text</p></div>'), (2, None), (3, "<p>none</p>"), (None, '<div class="field-content"><p>y</p></div>')], "k int, h string").withColumn("text", F.lit("clash"))
    got = {(r.k, r.ord): (r.text, r.header) for r in nodes.content_blocks(df, "k", "h").collect()}
    assert got == {(1, 0): ("HEAD", True), (1, 1): ("text", False), (None, 0): ("y", False)}
