"""Turns, sentences, languages and personal data of transcripts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palaver.llm import canon, languages, pii, sentences, turns
from palaver.llm.lines import lines

PEOPLE = "person_id long, account_id long, full_name string, name_native string"
VTT = "WEBVTT\n\n00:00:05.000 --> 00:00:06.000\n<v Abe>second.</v>\n\n00:00:01.000 --> 00:00:02.000\n<v Speaker 1>first.</v>\n"


def run_turns(spark, rows):
    docs = spark.createDataFrame(rows, "record_id string, account_id long, transcript string, label string")
    people = spark.createDataFrame([(1, 1, "Etsuko Kashimine", "樫峰 悦子")], PEOPLE)
    out: dict = {}
    for r in turns.turns(docs, people).orderBy("record_id", "turn_no").collect():
        out.setdefault(r.record_id, []).append((r.turn_no, r.speaker_no, r.text))
    return out


def test_turns(spark):
    got = run_turns(spark, [
        ("a", 1, "[00:00:09] Mori: last.\n[00:00:01] Kashimine-san: one\nmore\n[00:00:02] 樫峰: [laughter] two\n[00:00:03] Mori: えーと…\n[00:00:04] Etsuko Kashimine: three", "x"),
        ("b", 1, VTT, "x"), ("c", None, "Mori:\nhello\n\nAbe:\n(笑)\n\nMori:\nagain", "x"), ("d", 1, None, "x"), ("e", 1, "", "x"), ("f", 1, "Mori: b [00:00:02]\r\n--- recording paused ---\r\nAbe (00:00:01): a", "x"), ("f", 1, "Mori: b [00:00:02]\r\n--- recording paused ---\r\nAbe (00:00:01): a", "x"),
        ("g", 1, "no label here", "x"), ("h", 1, "00:00:02 Abe - later\n00:00:02 Mori - tie", "x"),
    ])
    assert got["a"] == [(1, 1, "one more two three"), (2, 2, "last.")]
    assert got["b"] == [(1, 1, "first."), (2, 2, "second.")]
    assert got["c"] == [(1, 1, "hello again")]
    assert got["f"] == [(1, 1, "b [00:00:02]"), (2, 2, "a")] and "d" not in got and "e" not in got
    assert got["g"] == [(1, 1, "no label here")] and got["h"] == [(1, 1, "later"), (2, 2, "tie")]


NAME, NOTE = "Maximiliana " + "o" * 120, "[" + "a door in the hall closes slowly, twice" + "]"
READ = [
    # (line, label, spoken): on either side of lengths that once counted
    ("Mori: hello", "Mori", True), (f"{NAME}: hello", NAME, True), ("Mori (head of the purchasing department): hello", "Mori (head of the purchasing department)", True), ("one two three four five: hello", None, True),
    ("NOTE short", None, False), ("NOTE " + "x" * 300, None, False), (f"Mori: {NOTE}", "Mori", False), ("Mori: [laughs]", "Mori", False), ("Mori: -- " + "recording goes on " * 5 + "--", "Mori", False), ("Mori: ♪ " + "la " * 40 + "♪", "Mori", False), ("<v " + "Ann " * 30 + "Lee>hello</v>", ("Ann " * 30 + "Lee"), True),
    ("Mori: " + "word " * 80 + "x: y", "Mori", True), ("word " * 80 + "x: y", None, True), ("", None, False), ("えーと…", None, False),
]


def test_both_readers_read_the_same_lines(spark):
    """The SQL expressions of problem 7 and the Python reader of 3, 4 and 6, over the same lines."""
    text = "\n".join(x for x, _, _ in READ)
    want = [(label, spoken) for _, label, spoken in READ]
    assert [(x.label, x.spoken) for x in lines(text)] == want
    d = spark.createDataFrame([("a", 1, text)], "record_id string, account_id long, transcript string")
    assert [(r.label, r.spoken) for r in turns.lines_of(d).orderBy("line_no").collect()] == want


def test_turns_without_text_are_the_same(spark):
    docs = spark.createDataFrame([("b", 1, VTT), ("c", None, "Mori:\nhello\n\nAbe:\n(笑)\n\nMori:\nagain\nAbe: x")], "record_id string, account_id long, transcript string")
    people = spark.createDataFrame([], PEOPLE)
    key = ["record_id", "turn_no", "speaker_no", "speaker"]
    assert {tuple(r) for r in turns.turns(docs, people, text=False).select(*key).collect()} == {tuple(r) for r in turns.turns(docs, people).select(*key).collect()}


def test_turns_of_nothing(spark):
    assert turns.turns(spark.createDataFrame([], "record_id string, account_id long, transcript string"), spark.createDataFrame([], PEOPLE)).count() == 0


SENTENCES = [
    ("Mori: We need 816 more readings, e.g. two. Dr. Abe counted No. 17 at 3.5 p.m. Could Lee look?", ["We need 816 more readings, e.g. two.", "Dr. Abe counted No. 17 at 3.5 p.m.", "Could Lee look?"]),
    ("Mori: The team wrote \"It is fine. We can ship.\" and signed it. Abe asked, \"Can it wait?\" Our depot agreed", ["The team wrote \"It is fine. We can ship.\" and signed it.", "Abe asked, \"Can it wait?\"", "Our depot agreed"]),
    ("森：担当者は「足ります。問題ありません。」と述べ、進めます。　監査室としては……延期になりました\n阿部: はい、確認いたしました", ["担当者は「足ります。問題ありません。」と述べ、進めます。", "監査室としては……延期になりました", "はい、確認いたしました"]),
    ("Rao: लेखा विभाग ने रु. 40 में बाँट दिए हैं। क्या दल देख सकते हैं?", ["लेखा विभाग ने रु. 40 में बाँट दिए हैं।", "क्या दल देख सकते हैं?"]),
    ("Mori: one of the crates was\nrebuilt today.\n[music]\nAbe: Um...\nLee: Fine.", ["one of the crates was\nrebuilt today.", "Fine."]),
]


SENTENCES.append(("Mori: " + "um, " * 12 + "um. We ship today. Fine.", ["um, " * 12 + "um. We ship today.", "Fine."]))  # however long the filler, it belongs to the sentence it opens


@pytest.mark.parametrize("text,want", SENTENCES)
def test_sentences(text, want):
    folded, at = canon.aligned(text)
    assert at is None
    assert [text[a : b + 1] for a, b in sentences.spans(folded, sentences.Model.load())] == want


def test_sentence_rows(spark):
    rows = [("a", "Mori: On​e. Two.", 1), ("a", "Mori: On​e. Two.", 1), ("b", None, 1), ("c", "", 1), ("d", "Abe: word " * 20_000, 1)]
    d = spark.createDataFrame(rows, "id string, text string, end_pos int")
    got = {(r.id, r.sentence_no): (r.end_pos, r.sentence) for r in sentences.sentences(d, "id", "text").collect()}
    assert got["a", 1] == (11, "On​e.") and got["a", 2] == (16, "Two.") and not any(k[0] in "bc" for k in got)
    assert {(r.id, r.end_pos) for r in sentences.sentence_ends(d, "id", "text").collect()} >= {("a", 11), ("a", 16)}
    assert sentences.sentences(d.limit(0), "id", "text").count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aB. !?。「」\"()\n:…1か森 ", max_size=60))
def test_spans_are_ordered_and_apart(s):
    folded, _ = canon.aligned(s)
    last = -1
    for a, b in sentences.spans(folded, sentences.Model.load()):
        assert last < a <= b < len(folded)
        last = b


LINES = [
    ("Could someone check whether the rules still cover the crates for Ember Ridge?", "en"), ("Kyunki server ruk raha tha, isliye team ne Willow Gate ke bakse wapas bheje hain.", "hi"), ("क्योंकि सर्वर रुक रहा था, इसलिए दल ने बक्से भेजे हैं।", "hi"),
    ("営業二課は金曜の夜に部品予測を確認いたしました。", "ja"), ("連絡先はops.k@mail.test.invalidで、担当が見ております。", "ja"), ("Haan woh, the billing crew paused the queue limits and counted the boxes.", "en"),
]


@pytest.mark.parametrize("line,lang", LINES)
def test_line_languages(line, lang):
    assert [x[1] for x in languages.label_lines(f"Abe: {line}", languages.Model.load())] == [lang]


def test_languages(spark):
    en, ja, hi = (f"Mori: {LINES[i][0]}" for i in (0, 3, 2))
    rows = [("a", "\n".join([en] * 4 + [ja]), None, "x"), ("b", "\n".join([en] * 5 + [hi]), "en-US", "x"), ("c", ja, "English", "x"), ("d", None, "ja", "x"), ("e", "", "", "x"), ("f", hi, " हिन्दी ", "x"), ("f", hi, " हिन्दी ", "x")]
    d = spark.createDataFrame(rows, "id string, text string, language string, lang string")
    got = {(r.id, r.line_no): (r.lang, r.label) for r in languages.languages(d, "id", "text", "language").collect()}
    assert got["a", 0] == ("mixed", None) and got["a", 5] == ("ja", None) and got["a", 1][0] == "en"
    assert got["b", 0] == ("en", "en") and got["c", 0] == ("ja", "en") and got["d", 0] == (None, "ja") and got["e", 0] == (None, None) and got["f", 0] == ("hi", "hi")
    assert languages.languages(d.limit(0), "id", "text", "language").count() == 0


def test_code_words_are_apart():
    c = languages.CODE
    assert all((c[i] != c[j]).sum() == 4 for i in range(4) for j in range(i))


PII = [
    ("Abe: You can reach me at ops_k7@mail.test.example about the kit.", [("email", "ops_k7@mail.test.example")]), ("Abe: Please send it to ovani at orchard dot co dot invalid, not to the box.", [("email", "ovani at orchard dot co dot invalid")]),
    ("Abe: My direct line is 080-0289-4965, so call today.", [("phone", "080-0289-4965")]), ("森: 直通は+81 3 0545 9416ですので、話はこちらへ。", [("phone", "+81 3 0545 9416")]), ("Abe: Order 2064-0238-8438 lists the rules for Aurora Gate, room 3-50.", []),
    ("Abe: The visa form shows number 6185-3115-7406 for the visit.", [("id_number", "6185-3115-7406")]), ("Abe: Ship the kit to Unit 2, 93 Old Quay Road, Lanterby, and mark them Silver Dune.", [("address", "Unit 2, 93 Old Quay Road, Lanterby")]),
    ("森: 送り先は「〒000-1644 霧原県椋瀬市葦原2-2-20」でお願いします。", [("address", "〒000-1644 霧原県椋瀬市葦原2-2-20")]), ("Abe: Could Kiritsuka look at the mirror nodes for Falcon Loom?", [("name", "Kiritsuka")]), ("森: 葦浦部長に検収書を195個お願いできますか？", [("name", "葦浦")]),
    ("Lee: Brightmill K.K. will mark the sheet as Umber Quay, part QX-491-654.", []), ("Lee: डॉ. समीरा वशेट्टी ने 142 पेटी सौंप दिए हैं।", [("name", "समीरा वशेट्टी")]),
]


@pytest.mark.parametrize("text,want", PII)
def test_personal_data(text, want):
    folded, at = canon.aligned(text)
    got = [(pii.KINDS[c.kind], text[slice(*pii._raw(text, at, c))]) for c in pii.Finder.load().in_text(folded)]
    assert got == want


def test_masked_gives_the_text_back(spark):
    rows = [(str(i), t, "x") for i, (t, _) in enumerate(PII)] + [("n", None, "x"), ("e", "", "x"), ("p", "Abe: [NAME_1] met Dr. Kanade Ashiura and Dr. Kanade Ashiura​.", "x"), ("l", "Abe: call me. " * 5000, "x")]
    d = spark.createDataFrame(rows, "id string, text string, mapping string")
    got = {r.id: r for r in pii.masked(d, "id", "text").collect()}
    assert len(got) == len(rows) and got["n"].masked is None and got["e"].masked == ""
    for i, t, _ in rows:
        if t is not None:
            s = got[i].masked
            for p, o in sorted((got[i].mapping or {}).items(), key=lambda x: -len(x[0])):
                s = s.replace(p, o)
            assert s == t
    assert "Kiritsuka" not in got["8"].masked and "[NAME_1]" in got["8"].masked
    assert pii.personal_data(d.limit(0), "id", "text").count() == 0


def test_lines_layouts():
    text = "[00:00:01] Mori: a\nAbe (00:00:02): b\n00:00:03 Lee - c\nKim:\nd\nThis is the sheet again: e\nLee : [00:00:04] f\n♪♪\nうーん。"
    got = [(x.label, text[x.start : x.end], x.spoken) for x in lines(text)]
    assert got == [("Mori", "a", True), ("Abe", "b", True), ("Lee", "c", True), ("Kim", "", False), (None, "d", True), (None, "This is the sheet again: e", True), ("Lee", "f", True), (None, "♪♪", False), (None, "うーん。", False)]
