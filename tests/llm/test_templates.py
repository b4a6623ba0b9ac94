from siltstone.llm.templates import equivalence_classes, page_tokens, slots
from tests.conftest import rows

KIND = "host string, page int, html string, pos int, class string"


def page(i, words, items):
    lis = "".join(f"<li><b>Name</b> {x}</li>" for x in items)
    return f"<!DOCTYPE html><html><head><title>Shop {words}</title></head><body><div id='top'> Main menu </div> <p>{words}</p><ul>{lis}</ul><footer> Legal notice </footer></body></html>"


def test_template_and_slots(spark):
    data = [("h", i, page(i, f"own{i} text{i}", [f"i{i}{k}" for k in range(i % 3 + 1)]), 1, "c") for i in range(8)]
    data += [("h", 100 + i, "# not a page", 1, "c") for i in range(4)] + [("other", 1, page(1, "x", ["y"]), 1, "c"), (None, 1, page(1, "x", ["y"]), 1, "c"), ("h", None, "<html>", 1, "c"), ("h", 50, None, 1, "c")]
    df = spark.createDataFrame(data + data[:3], KIND)
    classes = equivalence_classes(page_tokens(df))
    got = classes.collect()
    outer = [r for r in got if r.token == "<html>"][0]
    tokens = [r.token for r in sorted(got, key=lambda r: r["rank"]) if r["class"] == outer["class"]]
    assert tokens[:5] == ["<!DOCTYPE html>", "<html>", "<head>", "<title>", "Shop"] and "menu" in tokens and tokens[-1] == "</html>" and outer.parent is None
    inner = [r for r in got if r.token == "<li>"][0]
    assert inner.parent == outer["class"] and {r.token for r in got if r["class"] == inner["class"]} == {"<li>", "<b>", "Name", "</b>", "</li>"}
    text = {r.page: [] for r in slots(df).where("host = 'h'").collect()}
    for r in slots(df).where("host = 'h'").orderBy("page", "slot").collect():
        text[r.page].append(r.content)
    assert text[4] == ["own4 text4", "own4 text4", "i40", "i41"] and len(text) == 8


def test_no_template(spark):
    assert equivalence_classes(page_tokens(spark.createDataFrame([], KIND))).count() == 0
    few = spark.createDataFrame([("h", 1, "<html>one two</html>", 0, ""), ("h", 2, "<html>three</html>", 0, "")], KIND)
    assert rows(slots(few), "page", "slot", "content") == [(1, 0, "one two"), (2, 0, "three")]
