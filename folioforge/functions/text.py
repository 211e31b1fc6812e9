"""Text scalars as columns. White space and word edges are Unicode ones, and "." stops at a newline only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# What each character becomes before texts are compared.
FROM = "“”‘’｢｣·ㆍ․∼～〜…"
TO = "\"\"''「」・・・~~~⋯"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"
SPACE = r"(?U)\s"


def chain(text: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, F.lit(s[0]), F.lit(s[1])), steps, text)


def strip(text: Column) -> Column:
    return chain(text, (r"(?U)^\s+|\s+$", ""))


def squeeze(text: Column) -> Column:
    return strip(chain(text, (r"(?U)\s+", " ")))


def unify_marks(text: Column) -> Column:
    return F.translate(text, FROM, TO)


def drop_tags(text: Column) -> Column:
    return chain(text, (r"<[^>]+>", ""))


def drop_structure(text: Column) -> Column:
    """Without range markers, underline and box tags and picture signs."""
    return chain(text, (r"\[[A-Z]:(START|END)\]", ""), (r"</?u>", ""), (r"<\s*보\s*기\s*>", ""), (r"<img[^>]*>", ""), (r"\[그림\]", ""))


def comparable(text: Column) -> Column:
    """Form in which two readings of a text are compared."""
    return squeeze(chain(unify_marks(text), (r"^\s*\d{1,2}\s*[.．。]\s*", ""), (r"\*(?=[\"'“‘])", ""), (r"\((가|나|다|라)\)", ""), (r"<img[^>]*>", "[그림]")))


def normalised(text: Column, tags: bool = True) -> Column:
    """Form for a quick comparison of stems: white space closed up and a leading `N.` left out; without formatting tags unless kept."""
    bare = text if tags else chain(text, (r"(?i)</?(?:u|b|i|em|strong|sub|sup|span)\b[^>]*>", ""))
    return squeeze(chain(squeeze(bare), (r"^\d{1,2}\.\s*", "")))


def inline(text: Column) -> Column:
    return chain(text, (r"(?U)\s*\n\s*", " "))


def clamp_blank_lines(text: Column) -> Column:
    return strip(chain(text, (r"\n{3,}", "\n\n")))


def drop_page_marks(text: Column) -> Column:
    return chain(text, (r"--- 페이지 \d+ ---\n?", ""))


def drop_header(text: Column, keep_images: bool = False) -> Column:
    """Without a leading [s~e] range line, the request to read and, unless kept, pictures."""
    out = chain(text, (r"(?m)^\s*\[\s*\d+\s*[~～∼\-]\s*\d+\s*\][^\n]*\n?", ""), (r"(?s)다음.{0,80}?답하시오[.．。]?\s*", ""))
    return out if keep_images else chain(out, (r"<img[^>]*>", ""))


def render_brackets(text: Column) -> Column:
    return chain(text, (r"(?s)\[([A-E]):START\](.*?)\[\1:END\]", r'<span class="bracket" data-label="$1">$2</span>'))


def image_tags(text: Column) -> Column:
    return chain(text, (r"\[\[IMG:([^\]]+)\]\]", r'<img src="$1">'))


def image_tags_in_map(choices: Column) -> Column:
    return F.transform_values(choices, lambda _, v: image_tags(v))


def circled(text: Column) -> Column:
    """1 to 10 of a circled digit, else 0."""
    return F.when(F.length(text) == 1, F.instr(F.lit(CIRCLED), text)).otherwise(0)


def reassemble(stem: Column, box: Column, choices: Column) -> Column:
    """Stem, box and marked choices of a question as one text."""
    marks = F.transform(choices, lambda c, i: F.concat(F.substring(F.lit(CIRCLED), i + 1, F.lit(1)), F.lit(" "), c))
    return F.concat_ws("\n", stem, F.when(F.length(box) > 0, F.concat(F.lit("< 보 기 >\n"), box)), F.when(F.size(choices) > 0, F.array_join(marks, "　")))


def first_of(text: Column, marks: list[str]) -> Column:
    """0-based place of the first of the marks, or -1."""
    at = [F.nullif(F.instr(text, F.lit(m)), F.lit(0)) for m in marks]
    return F.coalesce(F.least(*at) if len(at) > 1 else at[0], F.lit(0)) - 1


def last_of(text: Column, marks: list[str]) -> Column:
    """0-based place of the last of the marks (one character each), or -1."""
    at = [F.nullif(F.instr(F.reverse(text), F.lit(m)), F.lit(0)) for m in marks]
    return F.coalesce(F.length(text) - (F.least(*at) if len(at) > 1 else at[0]), F.lit(-1))


def around(text: Column, at: Column, n: int = 30) -> Column:
    return F.substring(text, F.greatest(at - n, F.lit(0)) + 1, 2 * n)


def quoted(message: Column) -> Column:
    """The text in quotes, else what follows the colon, else empty."""
    q = F.nullif(F.regexp_extract(message, r"['\"“‘]([^'\"”’]+)['\"”’]", 1), F.lit(""))
    return F.coalesce(q, F.nullif(strip(F.regexp_extract(message, r"(?s):\s*(.+)$", 1)), F.lit("")), F.lit(""))


def key_of(location: Column, message: Column) -> Column:
    return F.concat_ws("|||", location, F.substring(message, 1, 80))


def fingerprint(filename: Column, location: Column, message: Column) -> Column:
    """12 hex digits that name a warning; its category is left out, so that sorting warnings anew changes nothing."""
    return F.substring(F.md5(F.concat_ws("|", filename, location, F.substring(message, 1, 80))), 1, 12)


def verdict(answer: Column) -> Column:
    """(judgment, reason) of a judge's reply."""
    judged = F.nullif(strip(F.regexp_extract(answer, r"판정\s*[:：]\s*([^\n]+)", 1)), F.lit(""))
    return F.struct(F.coalesce(judged, F.lit("보류")).alias("judgment"), strip(F.regexp_extract(answer, r"(?s)이유\s*[:：]\s*(.+)$", 1)).alias("reason"))


def choices_map(choices: Column) -> Column:
    """Choices given as a list, as the map that has numbers from 1 as keys."""
    return F.map_from_entries(F.transform(choices, lambda c, i: F.struct((i + 1).cast("string").alias("key"), c.alias("value"))))


def choices_list(choices: Column) -> Column:
    """Choices given as a map, as a list by number."""
    pairs = F.transform(F.map_entries(choices), lambda e: F.struct(e["key"].cast("int").alias("n"), e["value"].alias("v")))
    return F.transform(F.array_sort(pairs), lambda e: e["v"])


def acceptance(original: Column, corrected: Column) -> Column:
    """First reason to refuse a correction, or null if it is accepted."""
    ratio = F.length(corrected) / F.length(original)
    marks = lambda c: F.regexp_count(c, F.lit("[①②③④⑤]"))
    return (
        F.when(F.length(original) == 0, F.lit("empty"))
        .when(~ratio.between(0.7, 1.3), F.concat(F.lit("length "), F.format_string("%.2f", ratio)))
        .when(marks(original) != marks(corrected), F.lit("choices"))
        .when(corrected.rlike(r"\[[A-Z]:(START|END)\]"), F.lit("structure"))
        .when(corrected.rlike(r"다음.{0,80}?답하시오"), F.lit("intro"))
    )


def protect_indent(text: Column) -> Column:
    """Runs of blanks within lines closed up; a wide space that begins a line stays."""
    return chain(text, (r"(?<=\S)[ \t　]{2,}", " "), (r"(?m)[ \t]+$", ""), (r"(?m)^[ \t]+(?=　)", ""))


def join_endings(text: Column) -> Column:
    """Particles and endings that a line or a stray blank parted from their word, put back."""
    return chain(text, (r"(?U)(?<=[가-힣]) (?=(?:은|는|이|가|을|를|의|에|와|과|도|로|으로|에서|에게|까지|부터)\b)", ""), (r"(?<=[가-힣])\n(?=(?:다|요|까)[.?!])", ""))


def break_dialogue(text: Column) -> Column:
    """A new line before a speaker's name, or a stage direction, that follows the end of a sentence."""
    return chain(text, (r"([.!?…」』。])[ \t　]*((?:학생|사회자|교사|진행자|위원|갑|을|병)\s?\d?\s?[:：])", "$1\n$2"), (r"([.!?…」』。])[ \t　]*(\([^()\n]{2,30}\)\s)", "$1\n$2"))


# What marks a block of a page as no part of its text.
FORMS = "수험번호|성명란|제한시간|홀수형|짝수형|감독관|확인란|※ 답안지"
FOOTERS = "저작권|교육과정평가원|무단\\s?전재|복제를 금합니다|복제금지|인쇄하지 마십시오|이 문제지에 관한"
BETWEEN_SECTIONS = r"^\*?\s*확인\s*사항|◦\s*답안지|◦\s*이어서|선택과목.{0,20}문제가\s*제시|자신이\s*선택한\s*과목인지"
TITLES = r"\d{4}학년도|대학수학능력시험|[가-힣]+\s*영역\s*문제지|^[가-힣]+\s*영역$|학력평가|모의고사|성명\s*수험번호"
PAGE_NUMBER = r"^\d+\s*/\s*\d+$|^-\s*\d+\s*-$|^\d{1,3}$"
PAGE_HEADER = "국어영역|고3"
# Underlined texts that are no answers' underlines.
NO_UNDERLINE = r"^\[[\d～~]+\]|물음에 답하시오|^\*\s|^[-―]\s*.+[,，「].+[-―]?\s*$|확인 사항|선택한 과목인지 확인|이어서.*문제가 제시|답안지의 해당란|이를 바탕으로.*초고이다|^\d+\.\s"
SIGNS_ONLY = r"^(?:\[[A-E]\]|홀수형|짝수형|[①-⑳ⓐ-ⓩ㉠-㉿\d@#!%&*\s]+)$"


def boilerplate(block: Column) -> Column:
    """Whether a block of a page is a footer, header, title, notice or page number."""
    return strip(drop_tags(block)).rlike("|".join((FORMS, FOOTERS, BETWEEN_SECTIONS, TITLES, PAGE_NUMBER, PAGE_HEADER)))


def noise_underline(phrase: Column) -> Column:
    """Whether an underlined phrase is a header, note or source."""
    return strip(phrase).rlike(NO_UNDERLINE)


def noise_mark(phrase: Column) -> Column:
    """Whether an underline found on a page is one of a sign or a form's label."""
    t = strip(phrase)
    return (F.length(t) <= 2) | t.rlike(SIGNS_ONLY)


def money(cost: Column, rate: int = 1380) -> Column:
    """(dollars, won, thousands) of a cost, as a page shows them."""
    return F.struct(F.format_string("$%.4f", cost).alias("usd"), F.concat(F.lit("₩"), F.format_number(cost * rate, 0)).alias("krw"))


def tidy_choice(choice: Column) -> Column:
    """A choice without range marks and what a page's header left behind it."""
    return chain(
        inline(strip(chain(choice, (r"(?i)\[[A-D]:\s*(?:START|END)\]", "")))),
        (r"(?s)\s*\d{4}학년도.*$", ""), (r"(?s)\s*[가-힣]+영역.*$", ""), (r"(?s)\s*\[\d+\s*[~～]\s*\d+\].*$", ""), (r"\s*고\d+\s*$", ""), (r"(\s*\[[A-Z]\])+\s*$", ""),
    )


def leader_choices(block: Column) -> Column:
    """Choices of a layout that puts each mark behind its text and a row of dots, in the order of the marks; null unless there
    are three or more. A bullet begins the first text, else its last line is taken."""
    pairs = F.arrays_zip(F.regexp_extract_all(block, F.lit(r"(?s)(.*?)[·\s]{2,}([①②③④⑤])"), 1).alias("t"), F.regexp_extract_all(block, F.lit(r"(?s)(.*?)[·\s]{2,}([①②③④⑤])"), 2).alias("m"))
    first = lambda t: F.when(t.rlike(r"(?:^|\n)\s*[◦•∙]\s*\S"), F.regexp_extract(t, r"(?s).*(?:^|\n)\s*([◦•∙]\s*\S.*)$", 1)).otherwise(F.regexp_extract(t, r"([^\n]*)$", 1))
    bare = lambda t: tidy_choice(chain(strip(t), (r"^[◦•◆◇▪▫・\-]\s*", "")))
    texts = F.transform(pairs, lambda p, i: F.struct(F.instr(F.lit(CIRCLED), p["m"]).alias("k"), bare(F.when(i == 0, first(p["t"])).otherwise(p["t"])).alias("v")))
    return F.when((F.size(texts) >= 3) & block.rlike("·{3,}[①②③④⑤]"), F.transform(F.array_sort(texts), lambda x: x["v"]))
