import pytest
from conftest import rows

from tidemark.llm import lines, quality
from tidemark.llm.mail import own_body

COMMON = ["the", "of", "and", "to", "it", " Is ", "der", "die", "und", "ist"]
PROSE = "The pump of the north is old and it has to go to the shop. It is the last of the lot.\nAnd the crew is to see to it."
TABLE = "| a | b | c |\n|---|---|---|\n" + "\n".join(f"| {i} | {i * 7}.5 | reed |" for i in range(12))
HEAD = "From: a@b.example\nTo: c@d.example\nSubject: x\n"


def mail(body, extra=""):
    return f"{HEAD}{extra}\n{body}"


def test_own_body():
    assert own_body(None) is None and own_body("  \r\n ") is None and own_body(mail("")) is None
    assert own_body(mail("Hi,\n\nyes.\n\nOn Mon, 2 Jun 2025 01:00:00 +0000, A B wrote:\n> no\n> never\n")) == "Hi,\n\nyes."
    assert own_body(mail("> no\n\nmy answer")) == "my answer"
    assert own_body(mail("my answer\n\n-----Original Message-----\nFrom: x\n\nold")) == "my answer"
    assert own_body(mail("text\n\n*****\nCONFIDENTIAL: nothing here binds.\n")) == "text"
    assert own_body(mail("a=20=C3=A9=\nb", "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n")) == "a éb"
    assert own_body(mail("aGkgdGhlcmU=", "content-transfer-encoding: BASE64\n")) == "hi there"
    assert own_body(mail("x\r\ny").replace("\n", "\r\n").replace("\r\r", "\r")) == "x\ny"
    assert own_body("no headers at all: just text\nand more") is not None
    many = mail("pre\n--B\nContent-Type: text/plain\n\nplain\n--B\nContent-Type: text/html\n\n<p>html</p>\n--B--\n", 'Content-Type: multipart/alternative;\n boundary="B"\n')
    assert own_body(many) == "plain"
    assert own_body(mail("<p>a &amp; b<br>\nc</p>", "Content-Type: text/html\n")) == "a & b\nc"
    assert own_body(mail("--B\nContent-Type: application/pdf\n\nAAAA\n--B--", "Content-Type: multipart/mixed; boundary=B\n")) is None
    assert own_body(mail(TABLE)) == TABLE
    quoted = mail("my words\n\nOn Mon, A B wrote:\n| | a | b |\n| |---|---|\n| | 1 | 2 |\n")
    assert own_body(quoted) == "my words"


@pytest.mark.parametrize(
    ("text", "idle"),
    [
        (PROSE, False),
        (PROSE.lower().replace(".", ""), False),
        (TABLE, True),
        ("\n".join(f"- item {i}" for i in range(9)), True),
        ('"a";"b"\n' + "\n".join(f'"{i}";"no"' for i in range(9)), True),
        ("2025-01-01T00:00:00Z ERROR [x-1] the=1 of=2\n" * 5, True),
        ("00000000  a6 77 the of and to it is\n" + "00000010  0a 42 c1 d9 0f d6 85 e7 21\n" * 4, True),
        ("hahahahahahahahahahahahaha", True),
        ("reed24 fjord-pro onyx24 harbor juniper grove larchs mesa kelp dune", True),
        ("倉庫の人は報告書を見つけたと思いますが、まだ分かりません。", False),
        ("Thanks,\n-- \nA B", False),
        ("Hi all,\n\n" + PROSE + "\n\n- one pump\n- two pumps\n\n" + PROSE, False),
    ],
)
def test_prose_or_not(text, idle):
    c = lines.count(text, frozenset(w.strip().lower() for w in COMMON))
    junk = c.junk + lines.idle(c.head) + lines.idle(c.tail)
    assert (2 * junk > c.chars) == idle


def frames(spark, docs):
    words = spark.createDataFrame([("en", w) for w in [*COMMON, "the", None, ""]], "lang string, word string")
    return spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, piece int").repartition(3), words


DOCS = [(1, mail(PROSE)), (2, mail(TABLE)), (3, None), (4, ""), (5, mail((PROSE + "\n\n") * 300)), (6, mail((TABLE + "\n") * 60)), (7, "  \n"), (8, mail("x" * 70_000)), (9, mail("reed " * 9000)), (10, mail(PROSE + "\n\n" + TABLE[:40]))]


def test_mails_that_are_not_prose(spark):
    docs, words = frames(spark, DOCS)
    assert rows(quality.not_prose(docs, words)) == [(2,), (6,), (8,), (9,)]
    assert rows(quality.not_prose(docs.limit(0), words)) == []
    assert quality.not_prose(docs, words.limit(0)).count() >= 4


LONG = [
    (11, mail("Parts:\n    pump\n    hose\n" * 90)),
    (12, mail(" ".join(f"2025-01-01T00:00:0{i % 10}Z ERROR x={i} rc=143" for i in range(1500)))),
    (13, "then\tthe\t" * 9000),
    (14, mail("the end\n\n\n" * 40 + " \n" * 300 + "x. \n y" * 50)),
    (15, mail("| a | b |\n" * 3000 + "\n" + PROSE)),
]


@pytest.mark.parametrize("piece", [64, 1000])
@pytest.mark.parametrize("spread", [3, 10**6])
def test_pieces_add_up_to_the_whole(spark, monkeypatch, piece, spread):
    docs, words = frames(spark, DOCS + LONG)
    whole = [rows(f(docs, words, piece=10**7)) for f in (quality.prose_shares, quality.statistics)]
    monkeypatch.setattr(quality, "SPREAD", spread)
    monkeypatch.setattr(quality, "ROWS", 7)
    assert [rows(f(docs, words, piece=piece)) for f in (quality.prose_shares, quality.statistics)] == whole
    assert {r[0]: r[3] for r in whole[0]}[12] == 1.0 and {r[0]: r[3] for r in whole[0]}[9] == 1.0


def test_statistics_by_hand(spark):
    docs, words = frames(spark, [(1, "The pump is old.\n\nno end\n"), (2, None)])
    got = {r.doc_id: r.asDict() for r in quality.statistics(docs, words).collect()}
    assert got[1] == {"doc_id": 1, "n_chars": 25, "n_words": 6, "mean_word_length": round(18 / 6, 6), "symbol_share": round(1 / 25, 6), "n_lines": 2, "ended_share": 0.5, "common_share": round(2 / 6, 6), "prose": True}
    assert got[2]["n_chars"] == 0 and got[2]["prose"] is False


def test_pieces_lose_nothing():
    text = "ab cd\n" * 50 + "\n\n" + "x" * 500 + " y" * 100
    for size in (1, 7, 64, 1000):
        parts = lines.pieces(text, size)
        assert "\n".join(p for p, _ in parts) == text and all(len(p) <= size or "\n" not in p for p, _ in parts)
        assert all(after[:2] == p[:2] for (_, after), (p, _) in zip(parts, parts[1:])) or size == 1
        words = [p for p, _ in lines.word_pieces(text, size)]
        assert "".join(words) == text and [w for p in words for w in p.split()] == text.split()


def test_a_bounded_word_list(spark):
    quality.MOST_WORDS, kept = 3, quality.MOST_WORDS
    try:
        with pytest.raises(ValueError, match="frequent words"):
            quality.common_set(frames(spark, [])[1])
    finally:
        quality.MOST_WORDS = kept


def test_own_tables_below_a_line_with_a_comma():
    for above in ("Hi Anna, here is the list:", "As agreed, the rows of the list:"):
        for table in (TABLE, "+---+---+\n| a | b |\n+---+---+\n| 1 | 2 |\n+---+---+", "| a | b\n| 1 | 2"):
            assert own_body(mail(f"{above}\n{table}\n")) == f"{above}\n{table}"
    for above in ("Mon, 2 Jun 2025 01:00:00 +0000, A Bcd:", "28.06.2025, A Bcd:", "1749486947, A Bcd:", "On Mon, A B wrote:"):
        assert own_body(mail(f"my words\n\n{above}\n{TABLE}\n")) == "my words"


def test_all_inline_plain_parts():
    def parts(*bodies, kind="mixed", name="B"):
        return f"Content-Type: multipart/{kind}; boundary={name}\n\n" + "".join(f"--{name}\n{b}\n" for b in bodies) + f"--{name}--\n"

    text = "Content-Type: text/plain\n\n{}".format
    page = "Content-Type: text/html\n\n<p>{}</p>".format
    picture = "Content-Type: image/png\nContent-Disposition: inline\n\nAAAA"
    attached = "Content-Type: text/plain\nContent-Disposition: attachment\n\nno"
    assert own_body(HEAD + parts(text("one"), picture, text("two"), attached)) == "one\n\ntwo"
    assert own_body(HEAD + parts(text(""), picture, text("two"))) == "two"
    assert own_body(HEAD + parts(text("one"), text("other form"), page("html"), kind="alternative")) == "one"
    both = parts(text("one"), page("html"), kind="alternative", name="C")
    assert own_body(HEAD + parts(both, picture, text("two"))) == "one\n\ntwo"
    assert own_body(HEAD + parts(parts(text("one"), picture, text("two"), name="C"), page("html"), kind="alternative")) == "one\n\ntwo"
    assert own_body(HEAD + parts(page("one"), picture, page("two"))) == "one\n\ntwo"


@pytest.mark.parametrize("depth", [9, 3000])
def test_deep_mails(depth):
    inner = "Content-Type: text/plain\n\ndeep"
    for k in range(depth):
        inner = f"Content-Type: multipart/mixed; boundary=b{k}x\n\n--b{k}x\n{inner}\n--b{k}x--\n"
    assert own_body(HEAD + inner) == "deep"


def test_notices_and_quotes_by_their_form():
    kept = "Hello Ann,\nthis message is confidential between us, but the pump is broken."
    assert own_body(mail(kept)) == kept
    kept = "As you know nothing in this e-mail forms a contract and I agree. The rest is fine."
    assert own_body(mail(kept)) == kept
    kept = "See you.\n\n____\nThanks for the contract. Please delete the old one."
    assert own_body(mail(kept)) == kept
    notice = "This e-mail is intended only for the recipient. If it reached you in error, please destroy it."
    dutch = "Dit bericht is vertrouwelijk. Bent u niet de geadresseerde, verwijder het dan."
    assert own_body(mail(f"my words\n\n{notice}")) == own_body(mail(f"my words\n\n----\n\n{dutch}")) == "my words"
    assert own_body(mail(f"my words\n____\n{notice}\n\n> old")) == "my words"
    assert own_body(mail(f"{notice}\n\nmy words behind it")) == f"{notice}\n\nmy words behind it"
    assert own_body(mail(f"> old\n\nmy words\n{notice}")) == "my words"
    assert own_body(mail("my words\n\nBegin forwarded message:\n\nFrom: A <a@b.example>\nSubject: x\nDate: today\n\nold")) == "my words"
    assert own_body(mail("my words\n\n---- Doorgestuurd bericht ----\nVan: A\nAan: B\n\nold")) == "my words"
    for line in ("Op ma 2 jun. 2025 om 10:00 schreef A B:", "Den 2 juni 2025 kl. 10:00 skrev A B:", "Il 2 giu 2025 A B ha scritto:"):
        assert own_body(mail(f"my words\n\n{line}\n> old")) == "my words"
    listed = "As asked:\nPump: 4\nHose: 7\nValve: n/a"
    assert own_body(mail(listed)) == listed
