import pytest
from pyspark.sql import functions as F

from accordant import rules as R
from accordant.functions import classify, similarity, text, times, url

C = F.col


def test_clean_text(one):
    assert one(text.clean_text(C("a")), a="　A  b\t\n c ") == "A b c"
    assert one(text.clean_text(C("a")), a=None) == ""


@pytest.mark.parametrize(
    "raw, want",
    [
        ("https://WWW.Example.com/a//b/?utm_source=x&b=2&a=1#frag", "https://example.com/a/b?a=1&b=2"),
        ("ftp://example.com/x", ""),
        ("<https://e.com/p;v=1?q=a b~*>", "https://e.com/p?q=a+b~%2A"),
        ("https://e.com/?x=100%&source=y", "https://e.com?x=100%25"),
        ("HTTP://e.com/职位/1/", "http://e.com/职位/1"),
        ("https://e.com/p?k", "https://e.com/p?k="),
        ("", ""),
    ],
)
def test_normalize_url(one, raw, want):
    assert one(url.normalize_url(C("a")), a=raw) == want


def test_extract_url(one):
    assert one(url.extract_url(C("a")), a="见 <https://www.e.com/x/> 详情") == "https://e.com/x"
    assert one(url.extract_url(C("a")), a="无") == ""


def test_company_and_values(one):
    assert one(text.normalize_company(C("a")), a="星链智算科技有限公司") == "星链智算"
    assert one(text.normalize_company(C("a")), a="有限公司") == "有限公司"
    assert one(text.split_values(C("a")), a="上海、 杭州/上海|") == ["上海", "杭州"]


@pytest.mark.parametrize(
    "value, want",
    [("PM1001", True), ("2027", False), ("campus-2027", False), ("jobs", False), ("a", False), ("1999", False)],
)
def test_plausible_id(one, value, want):
    assert one(url.is_plausible_id(C("a")), a=value) is want


@pytest.mark.parametrize(
    "values, want",
    [
        (["职位 ID：AB-12 详情", "", ""], "AB-12"),
        (["t", "https://e.com/jobs/PM1001", ""], "PM1001"),
        (["t", "https://e.com/campus/jobs/PM1001", "https://e.com/position/XY77"], "XY77"),
        (["t", "https://e.com/x?jobId=QQ123", ""], "QQ123"),
        (["t", "https://e.com/x?id=QQ123", ""], None),
        (["t", "https://e.com/job/x?id=QQ123", ""], "QQ123"),
        (["t", "https://e.com/jobs/2027", ""], None),
    ],
)
def test_extract_record_id(one, values, want):
    got = one(url.extract_record_id(C("a"), C("b"), C("c")), a=values[0], b=values[1], c=values[2])
    assert got == want


@pytest.mark.parametrize(
    "link, job, want",
    [
        ("https://jobs.synthetic-example.com/jobs/PM-1001", "PM-1001", True),
        ("https://jobs.synthetic-example.com/news/PM-1001", "PM-1001", False),
        ("https://jobs.synthetic-example.com/jobs/2027", "2027", False),
        ("https://jobs.synthetic-example.com/jobs/campus-2027", "campus-2027", False),
        ("https://e.com/job?id=pm1", "PM1", True),
        ("https://e.com/x?id=pm1", "PM1", False),
    ],
)
def test_id_matches_url(one, link, job, want):
    assert one(url.id_matches_url(C("a"), C("b")), a=link, b=job) is want


@pytest.mark.parametrize(
    "value, want",
    [
        ("jobs.synthetic-example.com", ("jobs.synthetic-example.com", "", None)),
        ("jobs.nowcoder.com", (None, None, "aggregator")),
        ("com.cn", (None, None, "public_suffix")),
        ("127.0.0.1", (None, None, "ip_address")),
        ("job-boards.greenhouse.io", (None, None, "tenant_path_required")),
        ("myworkdayjobs.com", (None, None, "shared_parent")),
        ("wd5.myworkdayjobs.com", (None, None, "shared_parent")),
        (
            "https://job-boards.greenhouse.io/company-a/jobs",
            ("job-boards.greenhouse.io", "/company-a", None),
        ),
        ("https://User@WWW.Acme.com.:8443/x", ("acme.com", "", None)),
        ("bad_host.com", (None, None, "bad_host")),
    ],
)
def test_official_scope(one, value, want):
    assert tuple(one(url.official_scope(C("a")), a=value)) == want


def test_scope_matches(one):
    check = url.scope_matches(C("u"), C("d"), C("p"))
    assert one(check, u="https://x.acme.com/a", d="acme.com", p="")
    assert not one(check, u="https://xacme.com/a", d="acme.com", p="")
    shared = "job-boards.greenhouse.io"
    assert one(check, u=f"https://{shared}/Company-A/jobs", d=shared, p="/company-a")
    assert not one(check, u=f"https://{shared}/company-ab/jobs", d=shared, p="/company-a")
    assert not one(check, u=f"https://{shared}/company-b/jobs", d=shared, p="/company-a")


def test_record_host(one):
    assert one(url.record_host(C("a"), C("b")), a="", b="https://www.Acme.com:81/x") == "acme.com"


GOLD_KINDS = [
    ("产品类、算法类、运营类，岗位详见官网", ["上海", "杭州", "深圳"], None, "https://careers.synthetic.example/campus", "CAMPAIGN"),
    ("AI产品经理", ["上海"], "PM1001", "https://careers.synthetic.example/jobs/PM1001", "POSTING"),
    ("数据产品实习生", ["上海"], None, "https://jobs.synthetic.example/position/DATA-2048", "POSTING"),
    ("AI产品实习生", ["上海"], None, "https://careers.synthetic.example/jobs/AI-7788", "POSTING"),
    ("2027届校园招聘正式启动", ["上海", "杭州", "苏州"], None, "https://careers.synthetic.example/campus/2027", "CAMPAIGN"),
    ("解决方案工程师", ["上海"], "SOL-301", "https://jobs.synthetic.example/position/SOL-301", "POSTING"),
    ("研发类/产品类/市场类多个岗位", ["杭州"], None, "https://jobs.synthetic.example/graduate", "CAMPAIGN"),
    ("数据分析师", ["上海"], None, "https://careers.synthetic.example/openings/data-analyst-27", "POSTING"),
    ("2027届校园招聘", ["上海", "无锡"], None, "https://careers.synthetic.example/students", "CAMPAIGN"),
    ("某某研究中心", ["上海"], None, "", "CAMPAIGN"),
    ("神秘职位", ["a", "b", "c"], None, "", "CAMPAIGN"),
    ("神秘职位", ["a"], None, "", "POSTING"),
]


@pytest.mark.parametrize("title, cities, job, link, want", GOLD_KINDS)
def test_classify(one, title, cities, job, link, want):
    got = one(
        classify.classify_record(C("t"), C("c"), C("l"), F.lit(""), C("j")), t=title, c=cities, l=link, j=job
    )
    assert got["kind"] == want


def test_classify_details(one):
    got = one(
        classify.classify_record(C("t"), C("c"), C("l"), F.lit(""), C("j")),
        t="产品类、算法类、运营类，岗位详见官网", c=["上海"], l="https://e.com/jobs/AB12", j=None,
    )
    assert got["confidence"] == 0.82 and got["needs_review"] is True
    assert got["reasons"][0].startswith("broad_marker:岗位详见、产品类")


def test_role_counts(one):
    got = one(classify.role_counts(C("t")), t="研发类岗位、产品岗")
    assert (got["roles"], got["families"]) == (2, 3)


@pytest.mark.parametrize(
    "title, kind, industry, want, inferred",
    [
        ("智算平台产品经理", "POSTING", "", "智算平台产品经理", False),
        ("产品类岗位、研发类岗位", "CAMPAIGN", "芯片", "半导体技术产品经理", True),
        ("AI应用产品", "CAMPAIGN", "", "AI 产品经理", True),
        ("综合", "CAMPAIGN", "银行", "金融产品经理", True),
        ("综合", "CAMPAIGN", "", "产品经理", True),
    ],
)
def test_present_title(one, title, kind, industry, want, inferred):
    got = one(classify.present_title(C("t"), C("k"), C("i")), t=title, k=kind, i=industry)
    assert (got["title"], got["inferred"]) == (want, inferred)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for ch in a:
        new = [0]
        for j, other in enumerate(b, 1):
            new.append(row[j - 1] + 1 if ch == other else max(row[j], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize(
    "a, b",
    [
        ("数据产品经理", "数据产品实习生"),
        ("", "abc"),
        ("", ""),
        ("abcabc" * 10, "bca" * 20),
        ("x" * 62, "x" * 61 + "y"),
        ("kitten sitting", "sitting kitten"),
        ("ab" * 50, "ba" * 40),
        ("a" * 62, "a" * 100),
    ],
)
def test_indel_ratio(one, a, b):
    want = 1.0 if not a and not b else 2 * lcs(a, b) / (len(a) + len(b))
    assert one(similarity.indel_ratio(C("a"), C("b")), a=a, b=b) == pytest.approx(want)


def test_jaccard(one):
    check = similarity.jaccard(C("a"), C("b"))
    assert one(check, a=[], b=[]) == 1.0
    assert one(check, a=["x"], b=[]) == 0.0
    assert one(check, a=["X ", "y", "x"], b=["x", "z"]) == pytest.approx(1 / 3)


def test_terms_and_tags(one):
    assert one(text.contains_term(C("a"), "AI"), a="用ai做") is True
    assert one(text.contains_term(C("a"), "AI"), a="MAIL") is False
    assert one(text.contains_term(C("a"), "产品"), a="某产品线") is True
    dictionary = R.DecisionRules().dictionary
    assert set(one(text.tag_text(C("a"), dictionary), a="AI产品经理 数据")) == {"AI", "产品", "数据"}


def test_fold_years_ranks(one):
    folding = R.DecisionRules().type_folding
    assert one(text.fold_category(C("a"), folding), a=" 2027秋招 ") == "校招"
    assert one(text.fold_category(C("a"), folding), a="秋招补录") == "补录"
    assert one(text.fold_category(C("a"), folding), a="Other") == "other"
    assert one(text.extract_years(C("a")), a=["2027届", "x", "毕业2026"]) == ["2026", "2027"]
    ranks = R.DecisionRules().education_rank
    assert one(text.rank_of(C("a"), ranks), a=["本科及以上", "硕士"]) == [2, 3]


def test_line_spans(one):
    raw = "# 2027届硕士\r\n\n  - 负责 AI 产品 \n***\nlast "
    got = one(text.line_spans(C("a")), a=raw)
    assert [r["evidence"] for r in got] == ["2027届硕士", "负责 AI 产品", "last"]
    assert all(raw[r["start"] : r["end"]] == r["evidence"] for r in got)


def test_line_spans_many(one):
    raw = "\n".join(f"line {i} " * (i % 5) for i in range(500))
    got = one(text.line_spans(C("a")), a=raw)
    assert len(got) == 400
    assert all(raw[r["start"] : r["end"]] == r["evidence"] for r in got)


def test_fact_label(one):
    check = text.fact_label(C("a"), "经历证据")
    assert one(check, a="- 项目：做了事") == "项目"
    assert one(check, a="很" * 30) == "很" * 28 + "…"
    assert one(check, a="#") == "经历证据"


def test_missing_and_formula(one):
    for value in ("", " ", '""', "[]", "{}", "null"):
        assert one(text.is_missing(C("a")), a=value) is True
    assert one(text.is_missing(C("a")), a="0") is False
    assert one(text.formula_safe(C("a")), a=" =1+1") == "' =1+1"
    assert one(text.formula_safe(C("a")), a="a=1") == "a=1"


def test_times(one):
    assert str(one(times.parse_ts(C("a")), a="2026-08-10T08:00:00Z")) == "2026-08-10 08:00:00"
    assert str(one(times.parse_ts(C("a")), a="2026-08-10 垃圾")) == "2026-08-10 00:00:00"
    assert one(times.parse_ts(C("a")), a="招满为止") is None
    assert one(times.strict_date(C("a")), a="2026-9-3") is None
    edge = times.within(times.moment("2026-08-01 00:00:00"), "2026-08-15 00:00:00", 14)
    assert one(edge) is True
    assert one(times.older_than(times.moment("2026-08-01 00:00:00"), "2026-08-15 00:00:00", 14)) is False
    assert one(times.deadline_within(C("a"), "2026-08-01 10:00:00", 7), a="2026-08-08") is True
    assert one(times.deadline_within(C("a"), "2026-08-01 10:00:00", 7), a="2026-08-09") is False
    assert one(times.deadline_within(C("a"), "2026-08-01 10:00:00", 7), a="招满为止") is False


def test_common_subsequences_of_any_length(spark):
    """Around the borders of machine words and up to 500 characters, against the plain program."""
    import random

    rng = random.Random(5)
    lengths = [1, 2, 61, 62, 63, 123, 124, 125, 186, 250, 500]
    rows = []
    for n in lengths:
        for m in rng.sample(lengths, 5):
            few, many = "ab", "abcdefghijklmnopqrstuvwxyz数据😀"
            letters = rng.choice([few, many])
            x = "".join(rng.choices(letters, k=n))
            y = "".join(rng.choices(letters, k=m)) if rng.random() < 0.6 else "".join(c for c in x if rng.random() < 0.9)[:m] + "z"
            rows.append((len(rows), x, y))
    rows.append((len(rows), "a" * 500, "a" * 499 + "b"))
    frame = spark.createDataFrame(rows, "k int, x string, y string")
    got = {r["k"]: r["n"] for r in frame.select("k", similarity.lcs_length(C("x"), C("y")).alias("n")).collect()}
    assert got == {k: lcs(x, y) for k, x, y in rows}


def test_a_host_is_worked_out_once_for_all_domains(spark):
    """Inside a lambda no expression is shared, so what is written twice is worked out twice."""
    rows = spark.createDataFrame([("https://www.zhipin.com/a",), ("https://x.feishu.cn",), ("https://example.com/?a=1",), (None,)], "u string")

    def judged(link):
        return url.is_aggregator(url.bare_host(link))

    assert [r[0] for r in rows.select(judged(F.col("u"))).collect()] == [True, True, False, None]
    plan = rows.select(text.let(url.normalize_url(F.col("u")), judged))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract") < 30
