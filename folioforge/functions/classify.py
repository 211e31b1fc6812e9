"""Rule classifiers: warning messages, mismatches, file names, image names, page classes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LADDERS = ("snapshot", "review")


def _has(m: Column, *words: str) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & m.contains(w)
    return out


def _bracketed(m: Column) -> Column:
    return m.rlike(r"\[[A-E]\]")


def message_category(m: Column, ladder: str = "snapshot") -> Column:
    """Category of a warning; the first rule that holds decides. The review ladder is the coarser one."""
    if ladder not in LADDERS:
        raise ValueError(f"unknown ladder {ladder}")
    fine = ladder == "snapshot"
    lost = _has(m, "PDF 밑줄 텍스트") & (_has(m, "못") | _has(m, "찾"))
    mismatch = _has(m, "텍스트 불일치")
    rules: list[tuple[Column, str]] = []
    if fine:
        rules.append((_has(m, "<u>", "미확인"), "밑줄_JSON→PDF미확인"))
    rules.append((lost, "밑줄_PDF→JSON못찾음" if fine else "밑줄못찾음"))
    if fine:
        rules += [(_has(m, "<img>", "[그림]"), "img_그림불일치"), (_has(m, "이미지", "위치 불일치"), "img_그림불일치"), (_has(m, "이미지", "개수"), "이미지개수불일치")]
    rules += [
        (_bracketed(m) & (mismatch | _has(m, "범위 내 텍스트") | _has(m, "텍스트 미확인")), "bracket텍스트불일치"),
        (_has(m, "끝 위치 특정 불가") | _has(m, "시작 위치는 찾았"), "bracket위치특정불가" if fine else "bracket텍스트불일치"),
        (mismatch | _has(m, "선택지", "불일치"), "텍스트불일치"),
        (_has(m, "지문을 PDF에서 찾지 못") | _has(m, "대응하는 PDF 지문"), "지문못찾음"),
        (_has(m, "문항을 PDF에서 찾지 못") | _has(m, "PDF에서 해당 문항을"), "문항못찾음"),
    ]
    if fine:
        rules.append((_has(m, "SKIPPED"), "SKIPPED"))
    return cases(rules, "미분류" if fine else "기타")


def cases(rules: list[tuple[Column, str]], other: str | None) -> Column:
    """The name of the first rule that holds."""
    out = F.when(*(lambda c, v: (c, F.lit(v)))(*rules[0]))
    for c, v in rules[1:]:
        out = out.when(c, F.lit(v))
    return out.otherwise(F.lit(other))


def exam_year(text: Column) -> Column:
    """A year as four digits: 20yy before 학년도 or 년, else any 20yy, else yy before 학년도, else empty."""
    four = F.regexp_extract(text, "(20\\d{2})(?:학년도|년)", 1)
    any_ = F.regexp_extract(text, "(20\\d{2})", 1)
    two = F.regexp_extract(text, "(\\d{2})학년도", 1)
    return F.when(four != "", four).when(any_ != "", any_).when(two != "", F.concat(F.lit("20"), two)).otherwise("")


def academic_year(year: Column, exam: Column, name: Column) -> Column:
    """Exams of autumn count for the next school year, unless the name gives the school year already."""
    next_ = F.coalesce(exam, F.lit("")).rlike("수능|모의|모평") & ~F.coalesce(name, F.lit("")).contains("학년도")
    return F.when(~year.rlike(r"^\d+$") | ~next_, year).otherwise((year.cast("int") + 1).cast("string"))


def exam_type(text: Column) -> Column:
    month = F.regexp_extract(text, r"(\d{1,2})월", 1)
    kind = cases([(text.rlike("모의평가|모평"), "모의평가"), (text.rlike("학력평가|학평"), "학력평가")], None)
    return F.when(kind.isNotNull(), F.when(month != "", F.concat(month, F.lit("월 "), kind)).otherwise(kind)).when(text.contains("수능"), F.lit("수능")).otherwise("")


def subject_track(text: Column) -> Column:
    return cases([(text.rlike("화법|화작"), "화법과작문"), (text.rlike("언어|언매"), "언어와매체")], "공통")


def file_type(name: Column) -> Column:
    return cases([(name.rlike("정답|해설|답지"), "answer"), (name.rlike(r"국어\s*\(\s*\)"), "combined"), (name.rlike(r"국어\s*\("), "track")], "paper")


def image_kind(name: Column) -> Column:
    return cases([(name.contains("gap"), "gap"), (name.contains("crop"), "crop"), (name.contains("page"), "page"), (name.contains("fig"), "figure")], "other")


def mismatch_kind(field: Column, seen: Column, stored: Column, similarity: Column) -> Column:
    """Kind of a difference between what was seen and what is stored: box missing here or there, stem slightly, clearly or wholly off."""
    return cases(
        [
            ((field == "bogi") & seen & ~stored, "bogi_X"), ((field == "bogi") & ~seen & stored, "bogi_Y"),
            ((field == "stem") & (similarity < 0.2), "stem_Z"), ((field == "stem") & (similarity < 0.4), "stem_B"), (field == "stem", "stem_A"),
        ],
        "other",
    )


def severity_of_change(before: Column, after: Column) -> Column:
    return F.when(after < before, "improved").when(after > before, "worsened").otherwise("unchanged")


def digital_pages(text: Column, pages: Column) -> Column:
    """Whether a scan has text of its own: 80 characters a page or more, white space aside."""
    return F.length(F.regexp_replace(text, F.lit(r"(?U)\s"), F.lit(""))) / pages >= 80


def low_quality(text: Column) -> Column:
    return (F.length(text) >= 100) & (F.regexp_count(text, F.lit(" ")) / F.length(text) < 0.03)


def bbox_valid(box: Column) -> Column:
    inside = F.forall(box, lambda v: v.between(0, 1000))
    x0, y0, x1, y1 = (F.get(box, i) for i in range(4))
    return F.coalesce((F.size(box) == 4) & inside & (x0 < x1) & (y0 < y1) & ((x1 - x0) * (y1 - y0) >= 100), F.lit(False))


def scale_box(box: Column, width: Column, height: Column) -> Column:
    """A box on a 1000 by 1000 grid in pixels, cut to whole ones."""
    return F.transform(box, lambda v, i: (v * F.when(i % 2 == 0, width).otherwise(height) / 1000).cast("int"))


#: Tokens of a page image and of its reply, and prices of a million of each.
PAGE_TOKENS, REPLY_TOKENS, PRICE_IN, PRICE_OUT = 1300, 400, 3.0, 15.0


def estimate(pages: Column) -> Column:
    """(tokens, usd) that reading so many pages would take."""
    usd = pages * PAGE_TOKENS / 1e6 * PRICE_IN + pages * REPLY_TOKENS / 1e6 * PRICE_OUT
    return F.struct((pages * PAGE_TOKENS).cast("long").alias("tokens"), F.round(usd, 3).alias("usd"))
