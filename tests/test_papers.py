"""Contracts and committee papers against plain versions on random mixtures, odd white space and control characters."""

import random
import re

import pytest

from gridlark.operators import chunking, clauses, committee

SPACES = ["　", "\xa0", " "]


def plain_chunks(text):
    """Heads, articles with children, tables and general windows, read one after the other."""
    article = re.compile(r"(?:^|\n)\s*(?:제\s*[0-9]+\s*조|Article\s*[0-9]+)", re.I)
    cut = text.find("\n\n[표 데이터]\n")
    body, tables = (text, None) if cut < 0 else (text[:cut], text[cut + 2 :])
    starts = [m.start() for m in article.finditer(body)]
    out = []
    if not starts and tables is None:
        return [("standalone", "general", None, w) for w in chunking.windows(text)]
    head = body[: starts[0]].strip() if starts else body.strip()
    if len(head) > 1500:
        out += [("standalone", "header", None, head[i : i + 1500].strip()) for i in range(0, len(head), 1300) if head[i : i + 1500].strip()]
    elif head:
        out.append(("standalone", "header", None, head))
    for a, b in zip(starts, [*starts[1:], len(body)]):
        seg = body[a:b].strip()
        m = re.match(r"\s*(?:제\s*([0-9]+)\s*조|Article\s*([0-9]+))", seg, re.I)
        kind = "annex" if re.search(r"(?:^|\n)\s*(별지|별표|특약|부속서|첨부)", seg) else "article"
        number = int(m[1] or m[2])
        out.append(("parent", kind, number, seg))
        marks = [x.start() for x in re.finditer(r"(?:^|\n)\s*(?:[①-⑯]|[0-9]+\.\s)", seg) if x.start() > 0]
        if not marks:
            out += [("child", kind, number, w) for w in chunking.windows(seg, 400, 80)]
            continue
        group = ""
        for x, y in zip([0, *marks], [*marks, len(seg)]):
            part = seg[x:y].strip()
            if part and group and len(group) + len(part) > 400:
                out.append(("child", kind, number, group))
                group = part
            elif part:
                group = f"{group}\n{part}" if group else part
        out.append(("child", kind, number, group))
    for block in re.split(r"\n\s*\n", tables or ""):
        block = block.strip()
        if block and block != "[표 데이터]":
            out.append(("standalone", "table", None, block if block.startswith("[표 데이터]") else "[표 데이터]\n" + block))
    return out


def test_contracts_are_cut_like_a_plain_reading(spark):
    rng = random.Random(12)
    pieces = ["계약서 ", "\n제1조 (목적)", "\n제 22 조", "\nArticle 3 [Term]", "\n① 가나다 ", "\n② 라마 ", "\n1. one ", "\n", "\n\n", "가 " * 150, "낱말. " * 60, "\n별표 ", "끝", "제3조", "나" * 450, "머리 " * 700]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) + rng.choice(["", "", "\n\n[표 데이터]\na|b\n\nc|d\n \ne", "\n\n[표 데이터]\n"]) for _ in range(160)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {}
    for r in clauses.contract_chunks(df, "k", "t").orderBy("k", "no").collect():
        got.setdefault(r.k, []).append((r.role, r.kind, r.number, r.content))
    for k, t in enumerate(texts):
        assert got.get(k, []) == (plain_chunks(t) if t else []), repr(t)


@pytest.mark.parametrize("blank", SPACES)
def test_any_white_space_and_control_characters(spark, blank):
    text = f"머리\n제{blank}3{blank}조 (목적)\n①{blank}가\x01나"
    row = {r.role: r for r in clauses.articles(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t").collect()}
    assert row["parent"].number == 3 and row["parent"].title == "목적" and row["parent"].content.endswith("가나")
    paper = f"심의{blank}결과{blank}1.{blank}㈜회사의{blank}사천\x01{blank}태양광발전사업{blank}허가(안){blank}2.{blank}기본공급약관{blank}취소"
    rows = committee.agenda(committee.items(spark.createDataFrame([(1, paper)], "k long, t string"), "t"), "raw").orderBy("no").collect()
    assert [(r.no, r.company, r.title, r.kind) for r in rows] == [(1, "㈜회사", "사천 태양광발전사업 허가(안)", "NEW"), (2, "", "기본공급약관 취소", "CANCEL")]
    rounds = clauses.addenda(spark.createDataFrame([(1, f"부칙{blank}(2020.1.5){blank}이 조례는\x01 시행한다.")], "k long, t string"), "k", "t").collect()
    assert [(r.promulgated, r.text) for r in rounds] == [("20200105", "이 조례는 시행한다.")]


def test_more_items_than_a_hundred_thousand_stay(spark):
    df = spark.createDataFrame([(1, "결과" + " - 긴 사업 이름" * 100_050)], "k long, t string")
    assert committee.items(df, "t").count() == 100_050


def test_equal_results_stay_and_any_column_name(spark):
    results = spark.createDataFrame([(1, "사천 태양광", "x", "a"), (1, "사천 태양광", "x", "a"), (2, "다른 것", "y", None), (None, "z", "y", None)], "k int, title string, _n string, minutes_ string")
    minutes = spark.createDataFrame([(1, "사천 태양광 발전", "긴 글이다"), (1, "사천 태양광", "글"), (1, "무관", "없음"), (2, "다른 것", "")], "k int, heard string, said string").withColumnRenamed("heard", "title").withColumnRenamed("said", "text")
    got = sorted((r.k or 0, r._n, r.minutes) for r in committee.minutes_beside(results, minutes, ["k"], "title", "text").collect())
    assert got == [(0, "y", ""), (1, "x", "긴 글이다"), (1, "x", "긴 글이다"), (2, "y", "")]


def test_long_articles_without_marks_become_windows(spark):
    df = spark.createDataFrame([(1, "제1조 (목적) " + "가나다 " * 2000), (2, "제2조 짧다"), (None, "제3조 " + "라" * 900)], "k long, t string")
    rows = clauses.children(df, ["k"], "t").collect()
    assert max(len(r.content) for r in rows) <= 400 and {r.k for r in rows} == {1, 2, None}
