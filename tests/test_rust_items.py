from siltstone.functions.rust import parse_items, source_items
from tests.conftest import rows

SOURCE = '''//! crate text, fn not_an_item() {}
use std::fmt;

/// Says hello.
///
/// Second line with { a brace.
#[inline]
pub fn greet<T: Into<String>>(name: T) -> String where T: Clone { fn inner() {} let s = "fn in_string() {"; let c = '{'; format!("{}", 1) }

/** A holder
 * of things */
#[derive(Debug)]
pub(crate) struct Holder<'a, T> { pub field: &'a T }

impl<'a, T: Clone> Holder<'a, T> {
    /// Makes one.
    pub const fn new(x: &'a T) -> Self { Holder { field: x } }
    #[doc = "said by attribute"]
    fn private(&self) {}
}
impl<T> fmt::Display for Holder<'_, T> { fn fmt(&self) {} }

pub mod nested {
    /// Pings.
    pub trait Pingable { fn ping(&self) -> u32; fn twice(&self) -> u32 { self.ping() * 2 } }
    pub const MAX_PINGS: [u8; 2] = [1, 2];
    pub static mut COUNT: u32 = { 3 };
    mod deeper { pub enum Kind { A, B { x: u8 } } pub type Alias<T> = Vec<T>; pub union U { a: u8 } }
}
mod other;
/* /* nested */ fn hidden() {} */
#[macro_export]
macro_rules! shout { ($x:expr) => { fn made() {} } }
macro_rules! local { () => {} }
fn r#type() {}
pub unsafe extern "C" fn raw() { let r = r#"fn no() {"#; }
'''


def test_fixture():
    got = {(i["item_kind"], i["path"]): i for i in parse_items(SOURCE)}
    assert set(got) == {
        ("fn", "greet"), ("struct", "Holder"), ("impl", "Holder"), ("fn", "Holder::new"), ("fn", "Holder::private"), ("fn", "Holder::fmt"), ("mod", "nested"), ("trait", "nested::Pingable"),
        ("fn", "nested::Pingable::ping"), ("fn", "nested::Pingable::twice"), ("const", "nested::MAX_PINGS"), ("static", "nested::COUNT"), ("mod", "nested::deeper"), ("enum", "nested::deeper::Kind"),
        ("type", "nested::deeper::Alias"), ("union", "nested::deeper::U"), ("mod", "other"), ("macro", "shout"), ("fn", "type"), ("fn", "raw"),
    }
    greet = got["fn", "greet"]
    assert greet["doc_markdown"] == "Says hello.\n\nSecond line with { a brace." and greet["attrs"] == ["#[inline]"] and greet["visibility"] == "pub"
    assert greet["signature"] == "pub fn greet<T: Into<String>>(name: T) -> String where T: Clone" and (greet["line_start"], greet["line_end"]) == (4, 8)
    raw = SOURCE.encode()
    for i in got.values():
        part = raw[i["byte_start"] : i["byte_start"] + i["byte_len"]].decode()
        assert part.rstrip()[-1] in "};" and part.count("{") == part.count("}") or i["item_name"] in ("greet", "raw")
    assert got["struct", "Holder"]["visibility"] == "pub(crate)" and got["struct", "Holder"]["doc_markdown"] == "A holder\nof things"
    assert got["fn", "Holder::private"]["doc_markdown"] == "said by attribute" and got["fn", "Holder::private"]["visibility"] == "private"
    assert got["const", "nested::MAX_PINGS"]["signature"].startswith("pub const MAX_PINGS: [u8; 2] = [1, 2]")


def test_broken_and_empty():
    for t in (None, "", "   ", "fn", "fn f(", "struct", "impl", "mod m {", "/* open", '"open', "pub pub fn x() {}", "}}}} fn ok() {}", "const X: u8 = 1", "é fn ünlaut() {}"):
        parse_items(t)
    assert [i["item_name"] for i in parse_items("}}}} fn ok() {}")] == ["ok"]
    deep = "mod m { " * 300 + "fn f() {}" + " }" * 300
    assert len(parse_items(deep)) == 301
    assert len(parse_items("fn f() {}\n" * 20_000)) == 20_000


def test_table(spark):
    df = spark.createDataFrame([(1, SOURCE, "x"), (2, None, "y"), (3, "", "z"), (1, SOURCE, "x")], "file_id bigint, content string, item_kind string")
    got = source_items(df)
    assert got.count() == 42 and got.columns[0] == "file_id"
    assert rows(got.where("item_kind = 'macro'").distinct(), "file_id", "path") == [(1, "shout")]
    assert source_items(spark.createDataFrame([], df.schema)).count() == 0
