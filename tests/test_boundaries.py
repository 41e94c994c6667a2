import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.operators import boundaries as b
from tidewell.operators.chunking import chunk_text


def sentences(text, **options):
    ends = [0, *b.sentence_ends(text, **options), len(text)]
    return [text[x:y] for x, y in zip(ends, ends[1:])]


#: Cases of the annex's text and test data, ``|`` at the breaks.
@pytest.mark.parametrize("case", [
    "c.d", "C.d", "c.D", "C.D", "3.4", "U.S.A̡", "the resp. leaders are", "The quick brown fox can’t jump 32.3 feet, right?", "He said, “are you going?” |John shook his head.", '"Is it right?" |She asked.',
    "etc.)’ ‘(the", "etc.)’ |‘(The", "etc.)’ |‘(字", "字.|字", "字。|字", "Hello!|World", "Hello! |World", "a!,b", "a!) |B", "no.5 of 2.5", "one.\n|two", "one\n|two", "one.\r\n|two\r\n|\r\n|x", "one. \n|two",
    "他说“好。”|她走了！|为什么？|不知道。", "これは本です。|はい。", "Wow?! |Yes...|So", "Wow.. so", "Ends here. ", "e.g. this", "etc. it is", "(See above.) |Next.",
])
def test_sentence_rules(case):
    assert sentences(case.replace("|", ""), titles=frozenset()) == case.split("|")


def test_titles_end_no_sentence():
    assert sentences("Mr. Smith met Dr. Who. Then he left.") == ["Mr. Smith met Dr. Who. ", "Then he left."]
    assert sentences("Mr. Smith", titles=frozenset()) == ["Mr. ", "Smith"] and sentences("See (cf. Fig. 3). So.") == ["See (cf. Fig. 3). ", "So."]


def test_words_and_characters():
    text = "can't stop 3.14 語彙 カタカナ e\u0301x 👨\u200d👩\u200d👧!"
    ends = [0, *b.word_ends(text), len(text)]
    words = [w for w in (text[x:y] for x, y in zip(ends, ends[1:])) if w.strip()]
    assert words == ["can't", "stop", "3.14", "語", "彙", "カタカナ", "e\u0301x", "👨\u200d👩\u200d👧", "!"]
    ends = [0, *b.character_ends("e\u0301👨\u200d👩\u200d👧\r\nx"), 10]
    assert len(ends) == 5


def flat(blocks):
    return [x for k in blocks for x in (k, *flat(k.inner))]


@pytest.mark.parametrize(("family", "code", "n"), [
    ("rust", 'fn a() { let s = "}{"; }\nfn b<\'a>(x: &\'a str) -> char { \'{\' }\n', 2),
    ("rust", '/* { /* nested } */ { */ fn a() { r#"}"# }\nfn b() {}\n// }\nfn c() { b\'}\'; }\n', 3),
    ("c", 'int a() { return \'}\'; }\n#define X {\nint b() { char* s = "\\"}"; }\nauto r = R"x(} )" {)x";\n', 3),
    ("java", 'class A {\n  String s = """\n  } { "quoted"\n  """;\n  void m() { if (x) { y(); } else { z(); } }\n}\nclass B {}\n', 2),
    ("go", "func a() { s := `}{` }\nfunc b() { c := '}' }\n", 2),
    ("js", "const a = `x ${ f({ y: `}${1}{` }) } }`;\nfunction b() { return /[}/]\\/}/.test(x) }\nexport default { c: 1 };\n", 3),
    ("js", "app.get('/x', (req, res) => { res.send('}'); });\nlet y = a / b; let z = {};\n", 3),
])
def test_brackets_that_are_no_code(family, code, n):
    blocks = b.code_blocks(code, family)
    assert len(blocks) == n, [code[x.start : x.end] for x in blocks]
    assert "".join(code[x.start : x.end] for x in blocks).split() == code.split()


def test_nesting_and_coverage():
    code = "mod m {\n    // first }\n    fn a() { if x { y(); } else { z(); } }\n\n    struct S { f: u8, }\n}\n\nuse k;\nfn open() { {\n"
    top = b.code_blocks(code, "rust")
    assert [code[x.start : x.end].split()[0] for x in top] == ["mod", "use", "fn"]
    inner = top[0].inner
    assert ["a()" in code[x.start : x.end] for x in inner] == [True, False] and len(inner[0].inner) == 1 and len(inner[0].inner[0].inner) == 2
    for x in flat(top):
        assert all(x.start <= y.start < y.end <= x.end for y in x.inner)


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["rust", "c", "java", "go", "js"]), st.text(alphabet="ab{}()[];\"'`/*\\\n r#$ ", max_size=60))
def test_any_text_is_scanned(family, text):
    """Broken code, too: blocks lie one after the other, inside one another, and leave out blanks only."""
    def check(blocks, a, z):
        for x in blocks:
            assert a <= x.start < x.end <= z
            check(x.inner, x.start, x.end)
            a = x.end

    blocks = b.code_blocks(text, family)
    check(blocks, 0, len(text))
    assert "".join("".join(text[x.start : x.end] for x in blocks).split()) == "".join(text.split())


def test_functions_stay_whole_where_they_fit():
    body = "\n".join(f"    step_{i}(a, b);" for i in range(4))
    methods = "\n\n".join(f"  void m{i}() {{\n{body}\n  }}" for i in range(6))
    code = f"import x;\n\nclass Big {{\n  int f = 1; // {{ not a block\n\n{methods}\n}}\n\nclass Small {{ void n() {{}} }}\n"
    size = lambda t: len(t.split())
    chunks = chunk_text("A.java", code, 14, 0, size)
    for i in range(6):
        assert sum(f"void m{i}() {{\n{body}\n  }}" in c for c in chunks) == 1, chunks
    assert all(size(c) <= 14 for c in chunks) and "".join("".join(chunks).split()) == "".join(code.split())
    python = "import os\n\nclass A:\n    x = 1\n\n    @d\n    def m(self):\n        return 1\n\n    def n(self):\n        s = '''def no(): pass'''\n        return s\n"
    chunks = chunk_text("a.py", python, 9, 0, size)
    assert any(c.startswith("@d\n") and c.endswith("return 1") for c in chunks) and any("def n" in c and c.endswith("return s") for c in chunks)


@pytest.mark.parametrize("name", ["a.txt", "b.md", "c.rs", "d.js", "e.py", "f.go"])
@settings(max_examples=60, deadline=None)
@given(text=st.text(alphabet="ab .!?\n,#-字。“”{}()'\"👩\u200d\u0301", max_size=120), size=st.integers(1, 12))
def test_chunks_join_to_the_text(name, text, size):
    chunks = chunk_text(name, text, size, 0, len)
    assert "".join("".join(chunks).split()) == "".join(text.split())
    assert all(c == c.strip() and c for c in chunks)
    assert all(len(c) <= size or len(b.character_ends(c)) == 0 for c in chunks)


def test_scripts_without_blanks_are_cut_at_sentences_and_words():
    text = "他说好。" * 5 + "カタカナ語彙" * 4
    chunks = chunk_text("x.txt", text, 8, 0, len)
    assert "".join(chunks) == text and chunks[0] == "他说好。他说好。" and all(len(c) <= 8 for c in chunks)
    assert all(not c.startswith("タ") for c in chunks), "katakana words stay whole"


def test_a_batch_is_chunked_in_bounded_parts(monkeypatch):
    import pandas as pd

    from tidewell.operators import chunking

    monkeypatch.setattr(chunking, "MOST_CHARS", 10)
    b = pd.DataFrame({"text": ["a" * 6, None, "b" * 5, "c" * 30, "d", ""]})
    parts = list(chunking._bounded(b))
    assert [len(p) for p in parts] == [2, 1, 1, 2] and pd.concat(parts).equals(b)
    assert [len(p) for p in chunking._bounded(pd.DataFrame({"text": ["x"] * 1100}))] == [10] * 110
    assert len(list(chunking._bounded(b.iloc[:0]))) == 1
