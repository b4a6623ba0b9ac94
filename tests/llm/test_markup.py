import pytest

from siltstone.llm.markup import dialect, elements, structure
from tests.conftest import rows

MARKDOWN = '''---
title: not content
- neither
---
# Head &amp; `code` with [a link](http://x.y "t") #

<!-- hidden
- no item -->
Text with $x_1 + y$ and \\(z\\), costs $5 or $6 each.

Second *title*
--------------

- first __item__ with \\*stars\\*
    - nested snake_case_name
- last <br> line
  goes on
1) counted

````rust
```
# code & <b>
````

    indented <code>

$$
\\frac{a}{b}
$$
\\[ c^2 \\]
[1]: ./ref.md
'''

HTML = '''<!DOCTYPE html><html><head><title>No</title><style>p { }</style><script>if (1 < 2) { "<h1>x</h1>" }</script></head>
<body><nav><ul><li>Home</li></ul></nav><!-- <li>no</li> -->
<h1 class="a">One &amp; <em>two</em></h1><p>Here \\(a &lt; b\\) and $$c$$ but <code>$no$</code></p>
<ul><li>first <a href="#">link</a>
<ol><li>inner
<li>left open</ol></li><li>second</li></ul><pre><code class="language-x">if a &lt; b:
    &quot;x&quot;</code></pre><aside><h2>note</h2></aside></body></html>'''

WIKI = """{{Infobox|a={{b}}}}
== Head ''two'' ==
* one [[Page|label]]<ref name="x">note, 7</ref>
** nested '''bold'''
# counted <math>x^2</math>
: <math display="block">y
+ 1</math>
<pre>
a &lt; b
</pre>
<syntaxhighlight lang="c">
c &lt; d
</syntaxhighlight>
[[Category:Things]]"""

LATEX = r"""\documentclass{article}
\section{not yet}
\begin{document}
\section*{Head \emph{two} \& more}
% \section{old}
\begin{itemize}
\item one \href{http://x}{link} 5\%
\begin{enumerate}
\item inner \texttt{a\_b}
\end{enumerate}
\item last \textless{} $x$\footnote{no}
\end{itemize}
\begin{verbatim}
\item 50% raw
\end{verbatim}
\begin{align*}
a &= b
\end{align*}
\[ c \]
\end{document}
\section{after}"""


def of(text):
    return [(k, p) for k, _, p in elements(text)]


@pytest.mark.parametrize(
    "text, kind, want",
    [
        (MARKDOWN, "markdown", [("heading", "Head & code with a link"), ("formula", "x_1 + y"), ("formula", "z"), ("heading", "Second title"), ("list_item", "first item with *stars*"), ("list_item", "nested snake_case_name"), ("list_item", "last line goes on"), ("list_item", "counted"), ("code_block", "``` # code & <b>"), ("code_block", "indented <code>"), ("formula", "\\frac{a}{b}"), ("formula", "c^2")]),
        (HTML, "html", [("heading", "One & two"), ("formula", "a < b"), ("formula", "c"), ("list_item", "first link"), ("list_item", "inner"), ("list_item", "left open"), ("list_item", "second"), ("code_block", 'if a < b: "x"')]),
        (WIKI, "wiki", [("heading", "Head two"), ("list_item", "one label"), ("list_item", "nested bold"), ("list_item", "counted x^2"), ("formula", "x^2"), ("formula", "y + 1"), ("code_block", "a < b"), ("code_block", "c &lt; d")]),
        (LATEX, "latex", [("heading", "Head two & more"), ("list_item", "one link 5%"), ("list_item", "inner a_b"), ("list_item", "last < x"), ("formula", "x"), ("code_block", "\\item 50% raw"), ("formula", "a &= b"), ("formula", "c")]),
        ("Keep x < y and a * b * c; see ticket #7 and item 3) of it.\n\nIt's ''twice'' -- C:\\new.", "markdown", []),
    ],
)
def test_dialects(text, kind, want):
    for t in (text, text.replace("\n", "\r\n")):
        assert of(t) == want
    assert dialect(text) == kind


def test_sequence_numbers_and_edges():
    got = list(elements("# a\n\n- x\n- y\n\n# b"))
    assert got == [("heading", 1, "a"), ("list_item", 1, "x"), ("list_item", 2, "y"), ("heading", 2, "b")]
    for t in (None, "", " \n\t", "\ufeff"):
        assert of(t) == []
    assert of("```\nnever closed") == [("code_block", "never closed")]
    assert of("<pre><code>a &lt; b</code></pre>") == of("<PRE>a &lt; b</PRE>\n<P>text</P>") == of("<pre>\na &lt; b\n</pre>\n\ntext") == [("code_block", "a < b")]
    assert len(of("- item number\n" * 20_000)) == 20_000
    assert len(of("<p>" + "<ul><li>x" * 300)) == 300
    assert of("# \x000\x00 \x015\x01") == [("heading", "0 5")]


def test_structure(spark):
    kind = "doc_num_id bigint, content string, rec_id string, seq int"
    data = [(1, "# a\n\n- b", "x", 9), (1, "# a\n\n- b", "x", 9), (2, None, "x", 9), (None, "# a", "x", 9), (3, "plain", "x", 9)]
    got = structure(spark.createDataFrame(data, kind), "document_responses", "doc_num_id", "content")
    assert rows(got, "origin", "rec_id", "element", "seq", "plain") == [("document_responses", 1, "heading", 1, "a"), ("document_responses", 1, "list_item", 1, "b")]
    assert structure(spark.createDataFrame([], kind), "o", "doc_num_id", "content").count() == 0


def test_deep_nesting_leaves_no_markup():
    link, call = "a", "z"
    for k in range(20):
        link, call = f"[{link} b{k}](http://x.y/{k})", "{{t|" + call + "}}"
    got = list(elements(f"- x {link} end\n"))
    assert got == [("list_item", 1, "x a " + " ".join(f"b{k}" for k in range(20)) + " end")]
    assert list(elements("- x [[a](b)](g)\n")) == [("list_item", 1, "x a")]
    wiki = f"== Head ==\n* item {call} end\n* next [[Page|label]]\n* lone }}}} and {{{{ stay\n"
    assert [p for _, _, p in elements(wiki)] == ["Head", "item end", "next label", "lone }} and {{ stay"]
    assert list(elements("== H ==\n* a " + "{{" * 20_000 + "}}" * 20_000 + " b\n"))[1] == ("list_item", 1, "a b")


def test_unclosed_hidden_elements():
    page = "<!doctype html><html><head><title>No</title><body><h1>One</h1><section><nav><ul><li>Home</li></ul></section><p>x</p><ul><li>two</li></ul></body></html>"
    assert list(elements(page)) == [("heading", 1, "One"), ("list_item", 1, "two")]
