"""No text of a real page is lost: captions that come first or have no media, and heads without an end tag."""

import pytest

from papyra.llm import media_columns

PAGES = [
    ("<figure><figcaption>Cap</figcaption><img src=a alt=x><img src=b></figure>after", [("a", "Cap"), ("b", "Cap"), "after"]),
    ("<figure><img src=a><figcaption>Cap</figcaption><img src=b></figure><img src=c alt=z>", [("a", "Cap"), ("b", "Cap"), ("c", "z")]),
    ("<p>one<figure><figcaption>Cap</figcaption><table><tr><td>cell</table></figure>two", ["one", "Cap", "cell", "two"]),
    ("<figure><pre>code</pre><figcaption>Cap</figcaption></figure><img src=a>", ["code", "Cap", ("a", None)]),
    ("<figure><img src=a><figcaption>One<figcaption>Two</figure>", [("a", "One Two")]),
    ("<html><head><title>no</title><meta charset=utf-8><body><p>yes<img src=a></p>more", ["yes", ("a", None), "more"]),
    ("<head><title>no</title><style>no</style><p>yes</p>", ["yes"]),
    ("<head><script>no</script> loose <b>text</b>", ["loose text"]),
    ("<head><title>no</title></head>yes", ["yes"]),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_sequence(page, want):
    found = media_columns.parse_sequence(page)
    assert [x["text"] if x["kind"] == "text" else (x["media"], x["caption"]) for x in found] == want
    assert [x["position"] for x in found] == list(range(len(found)))
