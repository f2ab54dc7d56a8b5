import base64

import pytest

from calypile.llm import residue as R
from calypile.llm.messages import own_paragraphs, repaired

HEAD = "From: A B <a@b.test>\nSubject: {{name}} undefined\nMIME-Version: 1.0\n"


def mail(body, kind='text/plain; charset="utf-8"', transfer="8bit"):
    return f"{HEAD}Content-Type: {kind}\nContent-Transfer-Encoding: {transfer}\n\n{body}"


def flat(text):
    return [p for part in own_paragraphs(text) for p in part]


def test_parts_encodings_and_quotes():
    assert flat(mail("One\nline\n\nTwo")) == ["One\nline", "Two"]
    assert flat(mail("One\r\n\r\nTwo").replace("\n", "\r\n")) == ["One", "Two"]
    assert flat(mail("caf=C3=A9 =\nau lait", transfer="quoted-printable")) == ["café au lait"]
    assert flat(mail(base64.encodebytes("naïve text".encode()).decode(), transfer="base64")) == ["naïve text"]
    assert flat(mail(base64.b64encode(b"cut in the middle").decode()[:-3], transfer="base64"))[0].startswith("cut in the mid")
    assert flat(mail("Mine\n\nOn Mon, x@y.test wrote:\n> Dear {{name}},\n> hello\n\nBelow too")) == ["Mine", "Below too"]
    assert flat(mail("Mine\n\n-----Original Message-----\nFrom: x@y.test\n\nDear {{name}}")) == ["Mine"]
    assert flat(mail("Mine\n\nAm Montag schrieb x@y.test:\nDear {{name}}")) == ["Mine"]
    assert flat("just a body\n\nno headers") == ["just a body", "no headers"]
    assert flat("") == flat(None) == flat(" \n\t") == []


def test_html_and_multiparts():
    page = "<html><head><style>p{}</style></head><body><!-- {{x}} --><noscript>enable JavaScript</noscript><p>One<br>line</p><blockquote>{{q}}<blockquote>x</blockquote>y</blockquote><p>&#91;enter date] &lt;&lt;NAME&gt;&gt;</p><div style='display:none'>{{h}}</div></body></html>"
    assert flat(mail(page, "text/html")) == ["One\nline", "[enter date] <<NAME>>"]
    body = f"preamble\n--b1\nContent-Type: multipart/alternative; boundary=b2\n\n--b2\nContent-Type: text/plain\n\nPlain\n--b2\nContent-Type: text/html\n\n<p>Rich</p>\n--b2--\n--b1\nContent-Type: text/plain; name=a.txt\nContent-Disposition: attachment; filename=a.txt\n\n{{{{name}}}}\n--b1\nContent-Type: application/pdf\n\nxx"
    assert flat(mail(body, 'multipart/mixed; boundary="b1"')) == ["Plain", "Rich"]
    assert repaired("Å\x93uvre dÃ©jÃ\xa0 vu") == "œuvre déjà vu" and repaired("déjà") == "déjà"


def test_html_source_indentation_is_not_shown():
    page = "<body>\n  <table>\n    <tr>\n\t<td>\n\t <b> Dear {{name}},\n\n</b><br>\n    one  line\n</td></tr></table><pre>\n  x {{y}}\n</pre></body>"
    assert flat(mail(page, "text/html")) == ["Dear {{name}},\none line", "      x {{y}}"]
    assert [R.Passage(p, False).slots for p in flat(mail(page, "text/html"))] == [1, 0]
    assert flat(mail("<div style='white-space: pre-wrap'>a\n    b</div>", "text/html")) == ["a\n    b"]


def test_only_hidden_elements_are_dropped():
    for shown in ('style="overflow:hidden"', 'style="overflow: hidden"', "style='font-size:0.9em'", 'style="font-size: 0.75rem; color:red"', 'aria-hidden="true"', 'title="now hidden here"'):
        assert flat(mail(f"<p>a</p><div {shown}>{{{{h}}}}</div>", "text/html")) == ["a", "{{h}}"]
    for hidden in ("hidden", 'class="x" hidden', 'hidden=""', 'style="font-size:0"', "style='font-size: 0px;color:red'", "style=font-size:0", 'style="max-height:0.0em"', 'style="display: none"', 'style="visibility:hidden"'):
        assert flat(mail(f"<p>a</p><div {hidden}>{{{{h}}}}</div>", "text/html")) == ["a"]


@pytest.mark.parametrize("form", ["{{ name }}", "{{name | default}}", "${first_name}", "#{city}", "<%= Order_Id %>", "{% print room %}", "<<Full Name>>", "«last_name»", "%%CITY%%", "[%full_name%]", "*|FNAME|*", "__AMOUNT__", "@@USER.NAME@@", "[[last name]]", "[enter date]", "[YOUR company]", "(your name here)", "%(City)s", "{0}", "{user.name}", "undefined", "null", "NaN", "[object Object]"])
def test_slots_in_running_text_only(form):
    assert R.Passage(f"Dear {form},", False).slots == 1
    assert R.Passage(f"    Dear {form},", False).slots == 0
    assert R.Passage(f'It showed "Dear {form}" at the top.', False).slots == 0


@pytest.mark.parametrize("text", ["[AG]{3,5}C, then {A,C,G} and T{2}", "names in [K45], leave {} out", "sets {chr1, chr2, ...}", "[12:30:01] chunk 3 done", "it costs $5 or 100 %", "a_b __init__.py"])
def test_other_brackets_are_no_slots(text):
    assert R.Passage(text, False).slots == 0


@pytest.mark.parametrize("unit", ["%%A_", "{{a ", "{a ", "[%x.", "__a_", "<<A ", "$a_", "<div hidden ", "> | ", '"', "«a", "a@b.c wrote: ", "[enter ", "--b\n", "Ã¤", "=C3"])
def test_long_repetitions_end_soon(unit):
    import time

    start = time.time()
    for kind, transfer in (("text/plain", "8bit"), ("text/html", "8bit"), ("text/plain", "quoted-printable"), ("multipart/mixed; boundary=b", "7bit")):
        R.read(mail(unit * 5_000, kind, transfer))
    assert time.time() - start < 10


ORDINARY = ["The courier moved the boxes before noon and wrote it down.", "Please send the list before Friday, otherwise we lose the slot.", "We counted the reads again and the result is the same.", "Could you check whether the form in the archive is the right one?", "My train is late, start without me and keep a seat."]


def corpus():
    rows, want, n = [], set(), 0

    def add(text, case, times=1):
        nonlocal n
        for _ in range(times):
            rows.append((n, text, "clash"))
            if case:
                want.add(n)
            n += 1

    for i in range(400):
        a, b, c = ORDINARY[i % 5], ORDINARY[(i * 2 + 1) % 5], ORDINARY[(i * 3 + 2) % 5]
        add(mail(f"Dear Ann{i % 7},\n\n{a} {b}\n\n{c}\n\nKind regards,\nBo{i % 9}\n\n-- \nBo Low\nTel. 55{i}"), False)
    for i in range(12):
        add(mail(f"Dear {{{{name{i}}}}},\n\nyour parcel with number {{{{id}}}} has left our store.\n\n{ORDINARY[i % 5]}\n\nKind regards,\nBo"), True)
        add(mail(f"HTTP ERROR 50{i % 5}\nService Unavailable\nURI: /r/{i}"), True)
        add(mail("Please enable JavaScript to view this message.\n\n-- \nBo Low"), True)
        add(mail("Hi Ann,\n\n" + "Text goes here. " * 4 + "\n\nBest,\nBo"), True)
        add(mail(f'Dear Ann,\n\nThe mail this morning showed "Dear {{{{name}}}}" at the top. Please fix the mailing.\n\n{ORDINARY[i % 5]}\n\nBest,\nBo'), False)
        add(mail(f"Dear Ann,\n\nIn the letter script the first line must read\n\n    Dear {{{{name}}}},\n\nand the value comes from the sheet. {ORDINARY[i % 5]}\n\nBest,\nBo"), False)
        add(mail(f"Dear Ann,\n\nThe plot needs scripts. If it stays blank, enable JavaScript for that site.\n\n{ORDINARY[i % 5]} {ORDINARY[(i + 1) % 5]}\n\nBest,\nBo"), False)
    add(mail("Dear Ann,\n\nyour parcel with number undefined has left our store.\n\nKind regards,\nBo"), True, 2)
    for t in (None, "", " \n ", mail(""), HEAD):
        add(t, False)
    add(mail("Dear Ann,\n\n" + " ".join(ORDINARY * 4000) + "\n\nBest,\nBo"), False)
    return rows, want


def test_found(spark):
    rows, want = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, features string").repartition(5)
    got = R.decide(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    assert {r["doc_id"] for r in got if r["found"]} == want
    assert {r["doc_id"] for r in R.residue(df.limit(0), "doc_id", "text").collect()} == set()


def test_many_words_keep_their_own_weights():
    assert len({R._hash(f"w{i}") for i in range(300_000)}) > 299_900


def test_slots_behind_a_colon_are_weighed(spark):
    rows, want = corpus()
    for i in range(3):
        want.add(len(rows))
        rows.append((len(rows), mail(f"Dear Ann,\n\nyour access data for the store are:\n\nyour number is {{{{id}}}}\n\n{ORDINARY[i]}\n\nKind regards,\nBo"), ""))
    for i in range(12):
        rows.append((len(rows), mail(f"Dear Ann,\n\nIn the letter script the first line must read\n\nDear {{{{name{i}}}}},\n\nand the value comes from the sheet.\n\n{ORDINARY[i % 5]}\n\nBest,\nBo"), ""))
    got = R.decide(spark.createDataFrame(rows, "doc_id bigint, text string, features string").repartition(5), "doc_id", "text").collect()
    assert {r["doc_id"] for r in got if r["found"]} == want


def test_nothing_trusted(spark):
    df = spark.createDataFrame([(i, mail(f"Dear Ann,\n\n{t}\n\nBest,\nBo")) for i, t in enumerate(ORDINARY)], "doc_id bigint, text string")
    assert [r["found"] for r in R.decide(df, "doc_id", "text").collect()] == [False] * 5


def test_marks_of_any_form_are_found_in_one_pass():
    assert R.shaped("Dear ~~first_name~~, your ^^{order id}^^ is ++ready++")[1] == 3
    assert R.shaped("pay §§Amount.Due§§ now")[0].split() == ["pay", "¶shapea7a7¶", "now"]
    for plain in ("a ** 2 ** c", "see -- this -- one", "x == y", "10 %% of 20", "…name…", "((aside))", "~~open <<name", "*one*", "[K03]"):
        assert R.shaped(plain) == (plain, 0)
    assert R.shaped("~~" + "word " * 20_000 + "end~~")[1] == 1  # names of any length
    assert R.shaped("~~ " * 200_000)[1] == 0


def test_unlisted_shapes_are_learned_from_greetings(spark):
    """Marks that stand in greetings of short lines are learned as placeholders; the same kind of marks in prose only are not."""
    prose = ["we met the **whole team** of the second floor and had lunch", "the list of **open points** is short and everyone knows it", "please read the **third page** before the meeting on Monday", "nothing about the **new pump** has changed since last week"]
    docs = []
    for i in range(60):
        docs.append((len(docs), f"Dear ~~first_name~~,\n\nyour parcel number ~~order_id~~ has left our store.\n\nKind regards,\nShop {i % 7}"))
        docs.append((len(docs), f"Dear Anna,\n\n{prose[i % 4]}, {i} of us.\n\nKind regards,\nTeam {i % 5}"))
        docs.append((len(docs), f"Hello {{{{name}}}},\n\nyour ticket {{{{ticket}}}} was closed today.\n\nKind regards,\nDesk {i % 3}"))
    got = {r["doc_id"] for r in R.residue(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text").collect()}
    assert got == {i for i, t in docs if "~~" in t or "{{" in t}


def test_multiparts_of_any_depth():
    text = "Content-Type: text/plain\n\nHello {{name}}, all is well.\n"
    for depth in range(400):
        text = f'Content-Type: multipart/mixed; boundary="b{depth}"\n\n--b{depth}\n{text}\n--b{depth}--\n'
    assert [p.strip() for part in own_paragraphs(text) for p in part] == ["Hello {{name}}, all is well."]
    first = "\n".join(f"--x\nContent-Type: text/plain\n\npart {i}\n" for i in range(3))
    assert [p.strip() for part in own_paragraphs(f"Content-Type: multipart/mixed; boundary=x\n\n{first}\n--x--\n--x\n\nbehind") for p in part] == ["part 0", "part 1", "part 2"]
