import html as entities
import re

import pytest

from vigilseries.llm import html
from vigilseries.llm.samples import plain_page


@pytest.fixture(scope="module")
def tree():
    return html.train(*html.labelled_table())


def test_tree_fits_its_table(tree):
    x, y = html.labelled_table()
    assert (tree.keep(x) == (y > 0)).all()


def test_left_out_pages():
    """Trained without it, a labelled page is still mostly judged right."""
    right = total = 0
    for k in range(len(html.LABELLED)):
        others = html.LABELLED[:k] + html.LABELLED[k + 1 :]
        x, y = html.labelled_table([html.LABELLED[k]])
        right += (html.train(*html.labelled_table(others)).keep(x) == (y > 0)).sum()
        total += len(y)
    assert right / total > 0.85


def test_given_pages(spark, tree):
    """All text of the article, whatever is inside of it, and nothing else."""
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        story = re.search(r"<article>(.*?)(?:</article>|$)", row.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1|footer|body|html)>", story.replace("<br>", " "))
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
        assert html.main_text(row.html, tree) == "\n\n".join(p for p in parts if p)


LONG = "A sentence of the story that goes on for a while and says what there is to say. " * 2


@pytest.mark.parametrize(
    "page",
    [
        "<nav><a href=x>Home</a></nav><main><h1>Title</h1><p>{0}</p></main><aside><p>Side {0}</p></aside>",
        "<header><h1>Site</h1></header><article><h1>Title</h1><p>{0}<section id=comments><p>{0} I like it</section></article>",
        "<body><div class='cookie-banner'>We use {0}</div><article><h1>Title</h1><p>{0}<form>Your name</form></article>",
        "<script>var a='<p>x</p>'</script><style>p{{}}</style><article><h1>Title</h1><p>{0}</p></article><footer>{0}</footer>",
        "<ARTICLE><H1>Title</H1><P>{0}</ARTICLE><div class=sidebar><p>{0}</div>",
        "<article><h1>Title</h1><!-- <p>no</p> --><p>{0}</p><div class='ad'>Buy {0}</div></article>",
    ],
)
def test_furniture_is_left_out(tree, page):
    assert html.main_text(page.format(LONG), tree) == f"Title\n\n{LONG.strip()}"


@pytest.mark.parametrize(
    "page",
    [
        "<article class='post tags-news header-large'><h1>Title</h1><p>{0}</article>",
        "<main class='search-page'><article class='share-open related-none alert-on'><h1>Title</h1><p>{0}</article></main>",
        "<div class='layout has-sidebar no-comments'><article><h1>Title</h1><p>{0}</article></div>",
        "<form id=all><div class='page sidebar-left'><main id=main><h1>Title</h1><p>{0}</main></div></form>",
        "<article><h1>Title</h1><p>{0}<article class='comment'><p>I like it</article></article>",
        "<article><h1>Title</h1><p>{0}</article><aside><article><p>{0}</article></aside>",
    ],
)
def test_names_do_not_lose_the_story(tree, page):
    assert html.main_text(page.format(LONG), tree) == f"Title\n\n{LONG.strip()}"


def test_tree_reads_densities_and_neighbours(tree):
    used = {html.FEATURES[f] for f in tree.feature if f >= 0}
    assert "density" in used and used & {"density_before", "words_before"} and used & {"density_after", "words_after"}
    x, y = html.labelled_table()
    plain = x[:, html.FEATURES.index("page_has_story")] == 0
    blind = x.copy()
    blind[:, [k for k, name in enumerate(html.FEATURES) if name.startswith("density")]] = 0
    assert (tree.keep(blind) == (y > 0))[plain].mean() < 0.8  # densities decide where no tag does


def test_given_pages_without_article_tags(spark, tree):
    """At least 95 % of the blocks are the same where no tag tells where the story is."""
    same = total = 0
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        want = html.main_text(row.html, tree).split("\n\n")
        got = html.main_text(re.sub(r"<(/?)article\b", r"<\1div", row.html), tree).split("\n\n")
        same, total = same + len(set(want) & set(got)), total + len(set(want) | set(got))
    assert total > 2000 and same / total >= 0.95


def test_left_out_plain_pages():
    """Plain pages that the tree was not trained on."""
    x, y = html.labelled_table([plain_page(k) for k in range(1000, 1200)])
    assert len(y) > 2000 and (html.train(*html.labelled_table()).keep(x) == (y > 0)).mean() > 0.97


def test_broken_markup_and_references(tree):
    page = "<article><p>a &lt;b&gt; &amp;amp; &eacute;&#233;&#xe9; &copy x\n\t y</i> <b>z<p>1 < 2 and 3 > 2<p attr='>'>end"
    assert html.main_text(page, tree) == "a <b> &amp; ééé © x y z\n\n1 < 2 and 3 > 2\n\nend"
    for bad in ("<", "<p", "<!--", "</", "<script>", "&", "<article", "<a href='", "<p>" * 5000, "x" * 500_000):
        html.main_text(bad, tree)


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, `row` long"
    data = [(1, "u", None, "t", 1), (2, None, "", None, 2), (None, "v", "<article><p>Hi</article>", "t", 3)]
    data += [data[2]] * 2
    pages = spark.createDataFrame(data, schema)
    got = html.extracted(pages).select("row.page_id", "row.url", "row.text", "text").collect()
    assert [tuple(r) for r in got] == [(1, "u", "t", ""), (2, None, None, "")] + [(None, "v", "t", "Hi")] * 3
    assert html.extracted(pages.limit(0)).count() == 0
