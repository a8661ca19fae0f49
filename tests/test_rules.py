"""Rule cases as data: what a text must and must not be reported for, rule by rule."""

import pytest
from pyspark.sql import functions as F

from redpencil.lexicon import Lexicon
from redpencil.operators.checker import check

PRESENT = {
    "R3": [("Breakfast\n\n\nLunch", "\n\n\n", "\n\n"), ("a\n\n\n\nb", "\n\n\n\n", "\n\n")],
    "R4": [("Top\n   indented", "   ", "")],
    "R5": [("Row one \nRow two", " ", "")],
    "R6": [("Above\n~~~~\nBelow", "~~~~", ""), ("Above\n-----\nBelow", "-----", "")],
    "R7": [("Bring your own cup\nAnd a spoon\nBring your own cup", "Bring your own cup", "")],
    "R8": [("See you soon see you soon, friends.", "See you soon see you soon", "See you soon")],
    "R9": [("🎈Games for all", "🎈", "🎈 ")],
    "R10": [("+Coffee and cake", "+", "+ ")],
    "R11": [("3)Wash the cups", "3)", "3) ")],
    "R12": [("1) Wash\n2) Dry\n3. Fold", "3.", "3)")],
    "R13": [("* Red\n* Blue\n- Green", "-", "*")],
    "R14": [("GRAND SPRING opening PARTY TODAY\nCome along.", "opening", "OPENING")],
    "R17": [("Lưu ý : mang theo ô", "Lưu ý : mang theo ô", "Lưu ý: mang theo ô")],
    "R18": [("Địa điểm, Online", "Địa điểm, Online", "Địa điểm: Online"), ("Địa điểm| Online", "Địa điểm| Online", "Địa điểm: Online")],
    "R19": [("Địa điểm Online", " ", ": ")],
    "R20": [("Read [the map](https://maps.example.org/7)", "[the map](https://maps.example.org/7)", "the map: https://maps.example.org/7")],
    "R21": [("A __quiet__ room", "__quiet__", "quiet")],
    "R22": [("Press `start` now", "`start`", "start")],
    "R23": [("Salt &lt; pepper", "&lt;", "<"), ("Fish &amp; rice", "&amp;", "&")],
    "R24": [("#tea #milk #TEA", "#TEA", "")],
    "R25": [("Post with #slow-food", "#slow-food", "#slowfood")],
    "R26": [("Follow #Oldmill_Corp", "#Oldmill_Corp", "#MillbrookGroup")],
    "R27": [("bread#fresh", "d#fresh", "d #fresh")],
    "R28": [("Ask @ mira_k", "@ mira_k", "@mira_k")],
    "R29": [("Ask @River Boat", "@River Boat", "@RiverBoat")],
    "R30": [("Write to box7 @example.org", "box7 @example.org", "box7@example.org")],
    "R32": [("Open http:// wiki.example.org/a", "http:// wiki.example.org/a", "http://wiki.example.org/a")],
    "R33": [("Open www.wiki.example.org/a!", "www.wiki.example.org/a!", "www.wiki.example.org/a")],
    "R34": [("The oldmill corporation sold flour.", "oldmill corporation", "Millbrook Group"), ("OLDMILL CORP SELLS FLOUR\nAnd oats.", "OLDMILL CORP", "MILLBROOK GROUP")],
    "R35": [("Rice from vietnam", "vietnam", "Việt Nam"), ("A walk in hcmc", "hcmc", "TP.HCM")],
    "R36": [("Fat 3,5 % at most", "3,5 %", "3,5%")],
    "R37": [("Ticket 80 k each", "80 k", "80k")],
    "R38": [("A 250mb film", "250mb", "250 MB")],
    "R39": [("Cost 12,500,000 in all", "12,500,000", "12.500.000")],
    "R40": [("Open 07:30-18:45", "07:30-18:45", "07:30 - 18:45")],
    "R41": [("Due 31/02/2027", "31/02/2027", "31/02/2027"), ("Due 30/02", "30/02", "30/02")],
    "R42": [("Gate shuts 24:61", "24:61", "24:61")],
    "R43": [("Chủ nhật, 02/03/2027", "Chủ nhật, 02/03/2027", "Chủ nhật, 02/03/2027")],
    "R44": [("Giao hàng ngày mai", "ngày mai", "ngày mai")],
    "R45": [("Call 0987 654 32", "0987 654 32", "0987 654 32")],
    "R46": [("Café corner", "é", "é")],
    "R47": [("Snacks for genz fans", "genz", "Gen Z")],
    "R48": [("The Top25 list", "Top25", "Top 25")],
    "R49": [("l Địa điểm: Online", "l ", "")],
    "R50": [("BU gives the talk", "BU", "BU")],
    "R51": [("two   gaps", "o   g", "o g")],
    "R52": [("Salt , sugar", "t ,", "t,")],
    "R53": [("Salt,sugar", ",s", ", s"), ("Stop!Go", "!G", "! G")],
    "R54": [("Warm soup🍲", "p🍲", "p 🍲"), ("Yes!🍲", "!🍲", "! 🍲")],
    "R55": [("Well. . . maybe", ". . .", "...")],
    "R56": [("Well...... maybe", "......", "...")],
    "R57": [("Really?? Yes", "??", "?"), ("Done.. Next", "..", ".")],
    "R58": [("Seats [ 12 ] left", "[ 1", "[1"), ("Seats [ 12 ] left", "2 ]", "2]")],
    "R59": [("Seats 12] left", "]", ""), ("Seats (12 left.", ".", ").")],
    "R60": [('Say "please now', "w", 'w"')],
    "R61": [("The SilverFern menu", "SilverFern", "Silver Fern")],
    "R62": [("Our APIGarden is open", "APIGarden", "API Garden")],
    "R63": [("Post # picnic pictures", "# picnic", "#picnic")],
    "R64": [("Buy Jam -Jar today", "Jam -Jar", "Jam-Jar")],
    "R65": [("A sucess story", "sucess", "success"), ("We recieve mail", "recieve", "receive")],
    "R66": [("Try fern tea today", "fern tea", "Fern Tea")],
    "R67": [("Mot dich vu tot", "dich vu", "dịch vụ")],
    "R68": [("Xin chuẫn bị", "chuẫn", "chuẩn")],
    "R69": [("Món này ngon lành", "ngon lành", "tuyệt vời")],
    "R71": [("We saw the the sea", "the the", "the")],
    "R72": [("Visit Harbor Light soon", "Harbor Light", "HarborLight")],
    "R75": [("On 5.8.2027 we met", "5.8.2027", "05/08/2027")],
    "R76": [("Doors 8h15", "8h15", "08:15"), ("lúc 6 giờ", "6 giờ", "06:00"), ("Doors 8:15", "8:15", "08:15")],
    "R77": [("Due 4/9 and 05/09 and 06/09", "4/9", "04/09")],
    "R78": [("Lưu ý; mang ô", ";", ":"), ("Lưu ý;mang ô", ";m", ": m")],
}
ABSENT = [
    ("Breakfast\n\nLunch", None, None), ("A plain sentence with nothing to mend.", None, None), ("Wait a little...", None, None),
    ("Bring a cup\nBring a spoon", None, None), ("#tea #milk #bread", None, None), ("Nice! 🍲 and more", None, None),
    ("1) Wash\n2) Dry\n3) Fold", None, None), ("* Red\n* Blue", None, None), ("Open 07:30 - 18:45", None, None),
    ("Due 28/02/2027", "28/02/2027", None), ("Due 29/02/2028", "29/02/2028", None), ("Gate shuts 23:59", "23:59", None),
    ("Seats (12) and [3] left", None, None), ("Say \"please\" now", None, None), ("it's Anna's cup", None, None),
    ("Visit HarborLight soon", None, None), ("The Silver Fern menu", None, None), ("A walk in Jam-Jar lane", None, None),
    ("Open https://sucess.example.org/recieve today", "sucess", None), ("Open https://sucess.example.org/recieve today", "recieve", None),
    ("Ask @vietnam and #vietnam", None, "Việt Nam"), ("Call 0987 654 321", None, None), ("Cost 12.500.000 in all", "12.500.000", None),
    ("Write to box7@post.example.org", None, "box7 @post.example.org"), ("Version 2.5 is out", "2.5", None), ("A 250 MB film", None, None),
    ("Our iPhone page", "iPhone", None), ("LinkedIn and YouTube", None, None), ("that that", "x", None), ("The receiver rang", None, "receive"),
]


@pytest.fixture(scope="module")
def issues(spark, lexicon):
    texts = sorted({c[0] for cases in PRESENT.values() for c in cases} | {c[0] for c in ABSENT})
    rows = [("w", "image", str(i), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "workspace_id string, source_type string, source_id string, text string")
    found = {t: [] for t in texts}
    for r in check(df, lexicon).collect():
        found[texts[int(r["source_id"])]].append(r)
    return found


def test_reported(issues):
    missing = [(rule, c) for rule, cases in PRESENT.items() for c in cases
               if not any(r["original"] == c[1] and r["suggestion"] == c[2] for r in issues[c[0]])]
    assert not missing, missing


def test_not_reported(issues):
    wrong = [(t, r["original"], r["suggestion"]) for t, o, g in ABSENT for r in issues[t]
             if (o is None or r["original"] == o) and (g is None or r["suggestion"] == g)]
    assert wrong == []


def test_spans_quote_the_text_and_do_not_overlap(issues):
    for text, rows in issues.items():
        end = -1
        for r in sorted(rows, key=lambda r: r["span_start"]):
            assert text[r["span_start"]:r["span_end"]] == r["original"]
            assert r["span_start"] >= end
            end = r["span_end"]


def test_caption_rules(spark):
    texts = ["  tea at noon", "Tea at noon  ", "Tea at noon,", "Tea at noon", "Tea at noon #tea", "Xong rồi. Quá đỉnh thật."]
    rows = [("w", "caption", str(i), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "workspace_id string, source_type string, source_id string, text string")
    got = {(int(r["source_id"]), r["reason_code"], r["original"], r["suggestion"])
           for r in check(df, Lexicon.default(), {1, 2, 73, 74, 79}).collect()}
    assert {(0, "R1", "  ", ""), (0, "R73", "t", "T"), (1, "R2", "  ", ""), (2, "R79", ",", "."),
            (3, "R79", "n", "n."), (5, "R74", "Quá đỉnh", "Rất ấn tượng")} <= got
    assert not any(i == 4 and code == "R79" for i, code, *_ in got)


def test_risky_words_bypass_guards(spark):
    df = spark.createDataFrame([("w", "image", "1", "Kế hoạch thất bại, cả nhóm phá sản.")],
                               "workspace_id string, source_type string, source_id string, text string")
    got = {(r["original"], r["severity"]) for r in check(df, Lexicon.default(), {70}).collect()}
    assert got == {("thất bại", "medium"), ("phá sản", "high")}


def test_a_lexicon_table_gives_what_an_inline_lexicon_gives(spark):
    from redpencil.operators.checker import rule_hits
    from redpencil.operators.dictionary import joined_hits

    lex = Lexicon(
        brand_terms=["Blue-Door", "R&D Lab"], do_not_change=["old mill"], product_terms={"blue door": "Blue-Door", "c++ club": "C++ Club", "a.b": "A.B"},
        preferred_spellings={"teh": "the", "blu": "Blue-Door shop"}, missing_tone_map={"bao mat": "bảo mật", "toc": "tốc"},
        preferred_wording={"very very good idea": "fine idea"}, risky_words={"boom": ("high", ""), "bang-bang": ("low", "")})
    texts = ["Teh blue door and the c++ club, a.b? BOOM bang-bang!", "Very very good idea. Very very good idea", "toc bao mat, toc", "baomat teh-teh _teh blu",
             "GRAND blue door OPENING PARTY TODAY\nold mill teh R&D Lab", "", "no hit at all"]
    df = spark.createDataFrame([("w", "caption", str(i), t) for i, t in enumerate(texts)], "workspace_id string, source_type string, source_id string, text string")
    rules = {65, 66, 67, 68, 69, 70, 74}
    key = lambda d: sorted((r["source_id"], r["span_start"], r["span_end"], r["original"], r["suggestion"], r["reason_code"]) for r in d.collect())
    inline, table = check(df, lex, rules), check(df, Lexicon(), rules, table=lex.to_df(spark))
    assert key(inline) == key(table) and len(key(inline)) >= 12
    plain = rule_hits(df.select("source_id", "text"), Lexicon(missing_tone_map=lex.missing_tone_map), {67}, ["source_id"], guard=False, resolve=False)
    joined = joined_hits(df.select("source_id", "text"), Lexicon(missing_tone_map=lex.missing_tone_map).to_df(spark), ["source_id"])
    spans = lambda d: sorted((r["source_id"], r["span_start"], r["span_end"], r["original"]) for r in d.collect())
    assert spans(plain) == spans(joined) and len(spans(plain)) == 3


def test_phrases_of_any_characters_are_met_from_a_table(spark):
    from redpencil.lexicon import Lexicon
    from redpencil.operators.checker import check

    lex = Lexicon(preferred_wording={"->": "→", "&": "and", "a b c": "abc", "(!)": "!", "x": "y", "=> so": "so"},
                  risky_words={"%%": ("high", "")}, product_terms={"& co": "& Co", "nova node": "NovaNode"}, protected_terms=["<3", "C++"])
    texts = ["go -> there --> x&y & z (!) end", "& co x a b c => so 5%% %%", "we <3 C++ & nova node, C++, x -> <3", "", "plain words only"]
    df = spark.createDataFrame([("w", "caption", str(i), t) for i, t in enumerate(texts)],
                               "workspace_id string, source_type string, source_id string, text string")
    rules = {66, 69, 70, 74}
    inline, table = check(df, lex, rules), check(df, Lexicon(), rules, table=lex.to_df(spark))
    rows = [sorted((r.source_id, r.reason_code, r.span_start, r.span_end, r.suggestion) for r in x.collect()) for x in (inline, table)]
    assert rows[0] == rows[1] and any(r[4] == "→" for r in rows[0])


def test_a_dropped_key_never_loses_a_hit(spark):
    from redpencil.operators import dictionary as dt

    words = [f"w{i}" for i in range(400)]
    df = spark.createDataFrame([(k, " ".join(words[k::7])) for k in range(7)], "id int, text string")
    lex = spark.createDataFrame([("l", f"{words[k]} {words[k + 7]}", "x") for k in range(300)] + [("l", w, "y") for w in words[::3]],
                                "list string, wrong string, right string")
    got = {(r.id, r.original) for r in dt.joined_hits(df, lex, ["id"]).collect()}
    want = {(k % 7, f"{words[k]} {words[k + 7]}") for k in range(300)} | {(int(w[1:]) % 7, w) for w in words[::3]}
    assert got == want
