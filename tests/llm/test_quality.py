import re
from collections import Counter

from lectorium.llm import quality

GAP = r"[\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = [w for w in re.split(GAP, text) if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    covered = {i + s for i, g in enumerate(grams) if times[g] > 1 for s in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": len(words) < 50 or 100 * len(covered) > 50 * len(words),
    }


TEXTS = [None, "", " \n\t ", "one", "a b a b a b a b", "x y z\nx y z\n\nx y z", "été ß 漢字 #$%", "tab\x0bvt\x0cff\rcr", "word " * 200,
         "\n".join(f"line number {i} ends here well." for i in range(40))]


def test_base_columns_equal_brute_force(documents):
    got = {r.doc_id: r for r in quality.quality_digest(documents(TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        for k, v in brute(t).items():
            assert got[i][k] == v, (i, k)


def test_lines_fall_one_by_one(documents):
    body = "\n".join(" ".join(f"w{i * 31 + j}" for j in range(14)) + "." for i in range(20))
    noisy = "Home | About | Contact\n" + body + "\nAll rights reserved.\nshort unclosed line"
    junk = "\n".join(f"wor{i}### thi{i}$$$ an{i}%%% of{i}*** th{i}&&&" for i in range(30))
    rows = {r.doc_id: r for r in quality.clean_lines(documents([body, noisy, junk])).collect()}
    assert rows[0].kept and rows[0].n_failed_lines == 0 and rows[0].cleaned_text == body
    assert rows[1].kept and rows[1].n_failed_lines == 3 and rows[1].cleaned_text == body
    assert not rows[2].kept and not rows[2].base_failed


def test_line_rules_in_several_languages(documents):
    good = ["Next to the river stood a house.", "Weiter unten steht ein Haus.", "漢" * 24, "a b c d e f g h i j k l"]
    bad = ["Home", "Next.", "Startseite - Menü - Anmelden.", "MENÜ.", "Accueil / Lire la suite.", "Inicio.", "a | b | c.", "漢" * 23,
           "Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.", "a b c d e f g h i j k"]
    rows = {r.doc_id: r for r in quality.clean_lines(documents(good + bad)).collect()}
    assert [rows[i].n_failed_lines for i in range(len(rows))] == [0] * len(good) + [1] * len(bad)


def test_empty_table_clashing_columns_and_repeated_rows(spark, documents):
    assert quality.quality_digest(documents([])).count() == 0
    two = documents([(7, TEXTS[-1]), (7, TEXTS[-1])])
    assert [r.n_words for r in quality.quality_digest(two).collect()] == [240, 240]
    clash = documents(["a b c"]).selectExpr("*", "'x' as n_words", "1 as kept", "2 as `odd name`")
    row = quality.clean_lines(clash).collect()[0]
    assert row.n_words == 3 and row.kept is False and row["odd name"] == 2
