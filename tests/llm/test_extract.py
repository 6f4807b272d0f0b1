import random
from functools import lru_cache

import pytest

from runscope.llm.dom import Page, Template, read_shape
from runscope.llm.extract import Summary, align, extract_text, host_of, judge

SCHEMA = "page_id long, url string, html string, host string, shape string, text string, flags int, salt int"


def texts(source):
    return [t for _, t, _ in Page(source).blocks]


def test_blocks_of_tidy_and_broken_markup():
    assert texts("<p>a<b>b</b> <i>c</i>d<br>e<p>f") == ["ab cd e", "f"]
    assert texts("x &amp;amp; &eacute;&#233;&#xe9;&nbsp;&lt;p&gt; &am &amp") == ["x &amp; ééé <p> &am &"]
    assert texts('<script>var t="</p><p>no";</script><style>p{}</style><p>yes<!-- <p>no --> still</p>') == ["yes still"]
    assert texts('<a title="a>b" href=x>in</a> 3 < 4 <= 5 </ignored>') == ["in 3 < 4 <= 5"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul>d</ul><table><tr><td>1<td>2<tr><td>3</table>") == ["a", "b", "c", "d", "1", "2", "3"]
    assert texts("<div>a</span></em></section>b</div>c") == ["a", "b", "c"]
    assert texts("<p>a</P ><SCRIPT>no</SCRIPT ><!--> b <!DOCTYPE html><?php x ?>c<p") == ["a", "b c"]
    assert texts("<script>never closed <p>x") == [] and texts("<!-- never closed <p>x") == [] and texts("") == []
    assert texts("İ<script>no</script>yes") == ["İyes"]
    assert texts("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after") == ["deep", "after"]


def test_shapes_fold_lists_and_show_marks():
    page = Page('<nav><ul><li>a<li>b</ul></nav><div class="Post-42 has-sidebar">x<p>1<h2>2</h2><p>3</div><p>t <span class="ad">u<span>v</span>w</span> z')
    assert page.shape == "page(nav!x(ul(li)),div.post-.has-sidebar@3(flow),flow(span.ad!x))"
    assert [(n, t) for n, t, _ in page.blocks] == [(3, "a"), (3, "b"), (4, "x"), (5, "1"), (5, "2"), (5, "3"), (6, "t"), (7, "uvw"), (6, "z")]
    assert Page("<table>" + "<tr class=odd><td>1<tr class=even><td>2" * 9 + "</table>").shape == "page(table(tr.odd(td),tr.even(td)))"


def random_tree(rng, depth=0):
    label = rng.choice("ab") if depth else "r"
    kids = [random_tree(rng, depth + 1) for _ in range(rng.randint(0, 3))] if depth < 3 else []
    return f"{label}({','.join(kids)})" if kids else label


def best_match(a, b):
    """Largest match by trying every choice."""

    @lru_cache(None)
    def lists(x, y):
        if not x or not y:
            return 0
        return max(lists(x[1:], y), lists(x, y[1:]), single(x[0], y[0]) + lists(x[1:], y[1:]))

    def single(x, y):
        return 1 + lists(tuple(x.kids), tuple(y.kids)) if x.label == y.label else 0

    return single(a, b)


def nodes_of(root, parent=None, place=0):
    yield root, parent, place
    for i, kid in enumerate(root.kids):
        yield from nodes_of(kid, root, i)


def test_alignment_is_a_largest_match_and_the_union_holds_both():
    rng = random.Random(5)
    for _ in range(300):
        one, two = random_tree(rng), random_tree(rng)
        template = Template(one)
        before = template.size
        mapping = template.align(two)
        size = len(list(nodes_of(read_shape(two))))
        assert len(mapping) == len(set(mapping)) == size
        assert size - (template.size - before) == best_match(read_shape(one), read_shape(two))
        held = {n.at: (n.label, None if p is None else p.at, i) for n, p, i in nodes_of(template.root)}
        assert len(held) == template.size
        for node, parent, place in nodes_of(read_shape(two)):
            label, above, at = held[mapping[node.at]]
            assert label == node.label and above == (None if parent is None else mapping[parent.at])
            if parent is not None and place:
                assert held[mapping[parent.kids[place - 1].at]][2] < at
        assert template.align(one) == template.align(one) and template.align(two) == mapping


def as_row(summary, shape):
    pages, signatures, told, chars, links = summary.row()
    return {"shape": shape, "pages": pages, "signatures": signatures, "texts": told, "chars": chars, "links": links}


def test_summaries_add_up_in_any_order():
    pages = [Page(f"<div>{i % 20}</div><p>same</p><p>{'x' * (i % 150)}") for i in range(400)]
    whole = Summary(3)
    for page in pages:
        whole.add_page(page)
    parts = []
    for k in range(7):
        part = Summary(3)
        for page in pages[k::7]:
            part.add_page(page)
        parts.append(as_row(part, pages[0].shape))
    for order in (parts, parts[::-1]):
        total = Summary(3)
        for row in order:
            total.add(row)
        assert total.row() == whole.row()


def found_by(spark, area, rows, **options):
    made = spark.createDataFrame([(i, u, h, "h", "s", "t", 1, 2) for i, (u, h) in enumerate(rows)], SCHEMA).repartition(5)
    found = extract_text(made, area, **options)
    assert found.columns == ["page_id", "url", "text"]
    return [r.text for r in sorted(found.collect())]


def plain_site(i, k):
    """Pages without telling names: equal head, one of two bottom lines, a list of links; some have an extra box."""
    box = "<div class='q7'><p>Our prizes</p></div>" if i % 3 == 0 else ""
    links = "".join(f"<li><a href='/{i}{j}'>Link {i}{j}</a></li>" for j in range(4))
    return (
        f"<html><body><div class='q1'><b>Site {k}</b></div><ul>{links}</ul>{box}<div class='q2'><h1>Title {i}</h1><p>Body {i} &amp; more.<p>Hello</div>"
        f"<div class='q3'>Line {i % 2}</div></body></html>"
    )


def test_constant_nodes_are_template_and_varying_slots_content(spark, own_area):
    rows = [(f"http://u@Site.org:80/{i}", plain_site(i, 1)) for i in range(40)]
    assert found_by(spark, own_area, rows) == [f"Title {i} Body {i} & more. Hello" for i in range(40)]


def test_buckets_salts_and_copies_change_nothing(spark, own_area):
    rows = [(f"http://a.org/{i}", plain_site(i // 2, 1)) for i in range(80)]
    for options in ({"shapes_per_bucket": 1}, {"hot_least": 3}):
        assert found_by(spark, own_area, rows, **options) == [f"Title {i // 2} Body {i // 2} & more. Hello" for i in range(80)]


def test_regions_asides_nulls_and_single_pages(spark, own_area):
    article = (
        "<header>Site</header><form>Search<input></form><div id=cookie-notice>We use</div><main><div>teaser</div>"
        "<article><header><h1>Head</h1><p>By A</p></header><p>One<span class=advert>buy</span></p><aside>no</aside><p>Two"
        "<div class='ShareBox'>share</div><section class=comments><article>me too</article></section></article></main><footer>f</footer>"
    )
    rows = [
        ("http://one.org/", article),
        (None, article),
        ("not an url", "<p>x and more than <a href=y>z</a></p><p><a>a link</a></p><ul><li><a>only links</a></ul><td>"),
        ("http://two.org/", None),
        ("http://two.org/", ""),
        ("http://two.org/", "   \n"),
        ("http://three.org/", "<main><p>m</main><p>outside"),
        ("http://three.org/", "<div id=content>c</div><p>outside"),
        ("http://four.org/", "<p>" + "long words " * 200_000),
    ]
    got = found_by(spark, own_area, rows)
    assert got[:2] == ["Head One Two"] * 2 and got[3:6] == ["", "", ""] and got[6:8] == ["m", "c"]
    assert got[2] == "x and more than z a link" and got[8] == ("long words " * 200_000).strip()


def test_empty_table(spark, own_area):
    assert found_by(spark, own_area, []) == []


def test_near_copies_with_equal_longest_block_are_no_evidence():
    rows = []
    for i in range(9):
        page = Page(f"<div><p>{'long ' * 30}</p></div><ul>n{i}</ul>")
        summary = Summary(4)
        summary.add_page(page)
        rows.append(as_row(summary, page.shape))
    shape, total, _ = align(rows)
    assert judge(shape, total, "h")[2:] == [4, 4]
    assert len(total.signatures) == 1


@pytest.mark.parametrize(
    ("url", "host"), [("HTTPS://a:b@X.org:8/p@q", "x.org"), ("//x", ""), (None, ""), ("mailto:x@y", ""), ("http://x?y", "x")]
)
def test_host_of(url, host):
    assert host_of(url) == host
