"""Classes of questions, documents and page elements, first match or best score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped

# Patterns of intents, in the order in which they are tried.
INTENTS = (
    ("code", r"code|function|component|hook|api (route|endpoint)|schema|database|implementation|source (file|code)|where in (the )?code|how is .+ (implemented|built|coded|stored)|developer|backend|frontend|typescript|\.tsx?|sql query|table (schema|structure)|column|which (file|module|class) |renders?|supabase|rpc|query"),
    ("troubleshoot", r"error|not working|issue|problem|failed|failing|fails|can'?t|cannot|won'?t|doesn'?t work|why (is|isn'?t|does|doesn'?t|can'?t|won'?t)|not (showing|posting|saving|appearing|reflecting|working|balanced?|calculating)|getting .+ error|throws?|exception|stuck|frozen|crash|bug"),
    ("effect", r"what (gets?|is|will be) (debited|credited)|accounting (entry|effect|treatment)|journal entry for|debit .+ credit|credit .+ debit|debit credit (for|of|in)|credit debit (for|of|in)|double entry (for|of)|which account (gets?|is|will be)|ledger effect|gl entry|dr[./]?cr|what is (the )?entry for"),
    ("steps", r"steps (for|to)|step[- ]by[- ]step|procedure (for|to)|process (for|of)|guide me (through|on)|walk me through|how (exactly|specifically) (do i|to|does)|detailed (steps|procedure|process|instructions)"),
    ("nav", r"where (is|do i|can i|to)|how (do i |to |can i )?(open|access|find|go to|get to|navigate|reach|see|view)|shortcut (for|to)|keyboard shortcut|hotkey|press which|which key|what key|path (to|for)|menu (for|of)|location of"),
    ("action_path", r"how (do i |to |can i )?(make|create|post|record|enter|add|pass|generate|cut|raise|prepare|issue|file|submit|save|write|book|lodge)"),
    ("definition", r"what (is|are)|explain|tell me about|describe|meaning of|definition of|what does .+ (do|mean)|what'?s (a |an |the )?[a-z]|define"),
)
# How a question starts, and names of features.
QUESTION_START = r"how|what|where|why|when|which|can|could|would|should|do|does|did|is|are|was|were|explain|tell|show|list|steps|step"
TOPICS = r"journal|voucher|invoice|payment|receipt|contra|ledger|trial\s*balance|day\s*book|balance\s*sheet|chart\s*of\s*accounts|party|parties|stock|vat|tds|payroll|report|sales|purchase|credit\s*note|debit\s*note"


def is_bare_topic(c: Column) -> Column:
    """A short name of a feature without a question."""
    q = stripped(c)
    words = F.filter(F.split(F.regexp_replace(q, "[?.,!]", ""), r"(?U)\s+"), lambda x: x != "")
    return (q != "") & ~q.rlike(rf"(?iU)\A({QUESTION_START})\b") & F.size(words).between(1, 4) & q.rlike(rf"(?iU)\b({TOPICS})\b")


def intent(c: Column) -> Column:
    q, found = stripped(F.coalesce(c, F.lit(""))), None
    for name, pattern in INTENTS:
        hit = q.rlike(rf"(?iU)\b({pattern})\b")
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found.when(is_bare_topic(q), "definition").otherwise("general")


# Key words of document classes.
LEGAL_ACT = r"ऐन|नियम|नियमावली|विनियम|विधेयक|अध्यादेश|संविधान|कानून|दफा|उपदफा|परिच्छेद|भाग|अनुसूची|Act|Ordinance|Regulation|Rule|Bill|Constitution"
LEGAL_CIRCULAR = r"परिपत्र|निर्देशन|आदेश|सूचना|Circular|Notice|Directive|राष्ट्र\s*बैंक|नेपाल\s*राष्ट्र|NRB|Nepal\s*Rastra"
FINANCIAL = r"वासलात|ब्यालेन्स\s*शीट|Balance\s*Sheet|नाफा\s*नोक्सान|Profit.*Loss|Income\s*Statement|नगद\s*प्रवाह|Cash\s*Flow|लेखापरीक्षण|Audit|Trial\s*Balance|वित्तीय\s*विवरण|Financial\s*Statement"
AUDIT = r"महालेखापरीक्षक|Auditor\s*General|लेखापरीक्षण\s*प्रतिवेदन|Audit\s*Report|अन्तिम\s*लेखापरीक्षण|Final\s*Audit"
BOOK = r"अध्याय|Chapter|विषयसूची|Table\s*of\s*Contents|Index|सन्दर्भ|Bibliography|References|ISBN|प्रकाशन|Publication|प्रकाशक|Publisher"
FORM = r"निवेदन|Application|फारम|Form|दरखास्त|भर्नुहोस|Fill\s*in|Signature|हस्ताक्षर|सही|मिति|Date"
#: Classes in the order that settles ties.
DOCUMENT_CLASSES = ("legal_act", "legal_circular", "financial_statement", "audit_report", "book", "newspaper", "form", "general")


def document_scores(text: Column, pages: Column | None = None, columns: Column | None = None, family: Column | None = None) -> dict[str, Column]:
    """Points of each class: key words, length, columns and the dominant font's family."""
    pages = F.lit(0) if pages is None else pages
    columns = F.lit(False) if columns is None else columns
    family = F.lit("unknown") if family is None else family
    has = lambda p: text.rlike(f"(?i){p}")
    n = lambda p: F.regexp_count(text, F.lit(f"(?i){p}"))
    points = lambda cond, k: F.when(cond, k).otherwise(0)
    legacy = family.isin("preeti", "kantipur", "sagarmatha")
    return {
        "legal_act": F.least(F.lit(40), 8 * n(LEGAL_ACT)) + points(pages > 50, 10) + points(legacy, 15),
        "legal_circular": points(has(LEGAL_CIRCULAR), 35) + points(legacy, 10),
        "financial_statement": points(has(FINANCIAL), 35),
        "audit_report": points(has(AUDIT), 35),
        "book": points(has(BOOK), 30) + points(pages > 50, 10),
        "newspaper": points(columns, 25),
        "form": F.least(F.lit(30), 10 * n(FORM)),
        "general": F.lit(0),
    }


def document_class(text: Column, **more: Column) -> Column:
    """struct(primary, secondary, confidence); under 15 points a document is general, whatever leads."""
    ranked = F.array_sort(F.array(*(F.struct((-v).alias("less"), F.lit(i).alias("place"), F.lit(k).alias("name")) for i, (k, v) in enumerate(document_scores(text, **more).items()))))
    best = -F.get(ranked, 0)["less"]
    return F.struct(F.when(best < 15, "general").otherwise(F.get(ranked, 0)["name"]).alias("primary"), F.get(ranked, 1)["name"].alias("secondary"), F.least(F.lit(100), best + 10).alias("confidence"))


# Beginnings of list items, captions and page numbers; characters of equations.
LIST_START = r"\A\s*(?:[क-ह][.)]\s|\([क-ह]\)\s|[०-९]+[.)]\s|\d+[.)]\s|[a-zA-Z][.)]\s|\([a-zA-Z]\)\s|\(\d+\)\s|[ivxIVX]+[.)]\s|\([ivxIVX]+\)\s|[-•●○▪▸►]\s)"
NESTED_START = r"\A\s*(?:\d+\.\d+[.)]\s|\d+\.\d+\.\d+[.)]\s|\([a-z]\)\s|\([ivx]+\)\s)"
CAPTION_START = r"(?i)\A(?:(?:Figure|Fig\.?|Table|Chart|Graph|Diagram|Map|Photo|Image)\s*\d|\s*[०-९\d]|(?:Source|:|Note|Reference|)\s*:)"
EQUATION = r"[=<>≤≥≠±∓×÷∑∏∫∂√∞]|\\(?:frac|sqrt|sum|int|alpha|beta|gamma|delta)"
PAGE_NUMBER = r"(?i)\A[\s\-–—]*(?:(?:page|p\.?|pag)\s*\d+|\d{1,4}|[- ]+\d{1,4}[- ]+|[०-९]{1,4}|[-–— ]+[०-९]{1,4}[-–— ]+)[\s\-–—]*\z"


def looks_like_heading(c: Column) -> Column:
    return ~c.rlike(r"[.।]\z") & (F.length(c) <= 120) & c.rlike(r"(?U)[\wऀ-ॿ]")


def list_level(c: Column) -> Column:
    bare = F.regexp_replace(c, r"(?U)\A\s+", "")
    indent = F.length(c) - F.length(bare)
    return (
        F.when(bare.rlike(r"\A\d+\.\d+\.\d+"), 3)
        .when(bare.rlike(r"\A\d+\.\d+") | bare.rlike(r"\A\([a-z]\)"), 2)
        .when(bare.rlike(r"\A\([ivx]+\)") | (indent > 8), 3)
        .when(indent > 4, 2)
        .otherwise(1)
    )


def list_marker(c: Column) -> Column:
    """The marker that a list item begins with, else empty."""
    plain = F.regexp_extract(c, f"(?U){LIST_START}", 0)
    return stripped(F.when(plain != "", plain).otherwise(F.regexp_extract(c, f"(?U){NESTED_START}", 0)))


def element_class(text: Column, size: Column, body_size: Column, bold: Column, before: Column | None = None) -> Column:
    """A page element's class by size, beginning and what stands before it (figure or table)."""
    before = F.lit(None).cast("string") if before is None else before
    t = stripped(text)
    ratio = F.when((size > 0) & (body_size > 0), size / body_size)
    short_bold = ratio.isNotNull() & bold & (F.length(t) < 100) & looks_like_heading(t)
    return (
        F.when(t == "", "empty")
        .when(ratio >= 1.6, "heading_1")
        .when(ratio >= 1.3, "heading_2")
        .when((ratio >= 1.1) & bold, "heading_3")
        .when(short_bold, "heading_3")
        .when(t.rlike(f"(?U){NESTED_START}") | t.rlike(f"(?U){LIST_START}"), "list_item")
        .when(t.rlike(f"(?U){CAPTION_START}"), "caption")
        .when(before.isin("figure", "table") & (size > 0) & (size < body_size * 0.9) & (F.length(t) < 200), "caption")
        .when(t.rlike(EQUATION) & (F.length(t) < 200) & (F.regexp_count(t, F.lit(EQUATION)) / F.length(t) > 0.15), "equation")
        .otherwise("paragraph")
    )


def block_class(mid_x0: Column, x1: Column, mid_y: Column, page_w: Column, page_h: Column, *, equation: Column, n_chars: Column, list_share: Column, n_lines: Column, first_line: Column, max_size: Column, body_size: Column, bold: Column) -> Column:
    """A text block's class by place, then equation, list, caption and heading; else paragraph."""
    width = x1 - mid_x0
    caption = r"(?iU)\A(?:Figure|Fig\.?|Table|Chart|Graph|Diagram|Photo|Image|छवि|तालिका|चित्र|सारणी)\s*[०-९\d]"
    return (
        F.when(mid_y <= page_h * 0.08, "header")
        .when(mid_y >= page_h * 0.92, "footer")
        .when(((x1 < page_w * 0.18) | (mid_x0 > page_w * 0.82)) & (width < page_w * 0.22), "margin_note")
        .when(equation & (n_chars < 80), "formula")
        .when((list_share >= 0.5) | ((n_lines >= 2) & (list_share >= 0.34)), "list")
        .when(first_line.rlike(caption), "caption")
        .when((max_size >= body_size * 1.15) & (bold | (max_size >= body_size * 1.35)) & (n_chars < 200), "heading")
        .otherwise("paragraph")
    )


def block_confidence(kind: Column, n_chars: Column) -> Column:
    # Confidence by class of block.
    base = {"header": 72.0, "footer": 72.0, "heading": 78.0, "list": 75.0, "caption": 70.0, "formula": 68.0, "margin_note": 68.0, "paragraph": 82.0}
    found = F.lit(75.0)
    for k, v in base.items():
        found = F.when(kind == k, v).otherwise(found)
    return F.when(n_chars > 20, F.least(F.lit(95.0), found + 5.0)).otherwise(found)


def ocr_eligible(kind: Column, contains_text: Column, contains_image: Column) -> Column:
    """Whether a block is ink that only recognition can read."""
    never = kind.isin("signature", "qr_code", "barcode", "figure", "chart", "formula", "stamp")
    return ~never & contains_image & ~contains_text


def route(kind: Column, *, contains_text: Column, contains_image: Column, contains_table: Column, encoding: Column, mixed: Column, has_legacy: Column, has_unicode: Column, legacy_font: Column, force_ocr: Column | None = None) -> Column:
    """How a block is read; the first rule that fits decides."""
    force_ocr = F.lit(False) if force_ocr is None else force_ocr
    unicode_font = has_unicode | encoding.isin("unicode", "mixed")
    ink = ocr_eligible(kind, contains_text, contains_image)
    return (
        F.when(force_ocr & ink, "ocr")
        .when(kind == "signature", "placeholder_signature")
        .when(kind == "qr_code", "qr_decode")
        .when(kind == "barcode", "barcode_decode")
        .when(kind == "figure", "placeholder_figure")
        .when(kind == "chart", "placeholder_chart")
        .when(kind == "formula", "skipped")
        .when(mixed | (encoding == "mixed"), "pdf_extraction")
        .when(contains_text & ~contains_image & ((encoding == "unicode") | (unicode_font & ~has_legacy) | (~legacy_font & ~has_legacy)), "pdf_extraction")
        .when(has_legacy | legacy_font, "legacy_conversion")
        .when(ink, "ocr")
        .when((kind == "table") | contains_table, "table_extraction")
        .when(kind == "stamp", "placeholder_stamp")
        .when(kind == "image", "placeholder_image")
        .when(contains_text, "pdf_extraction")
        .otherwise("skipped")
    )


def zone(mid_y: Column, page_h: Column, margin: float = 0.08) -> Column:
    return F.when(mid_y <= page_h * margin, "header").when(mid_y >= page_h * (1 - margin), "footer").otherwise("body")


def is_footnote(text: Column, size: Column, y0: Column, page_h: Column) -> Column:
    t = stripped(text)
    return (size > 0) & (size < 9) & (t.rlike(r"(?U)\A[\d*†‡¹²³⁴⁵⁶⁷⁸⁹⁰]+[.)]\s") | (t.rlike(r"(?U)\A\d+\s") & (y0 > page_h * 0.8)))


def zone_probabilities(text: Column, rel_y: Column, size: Column | None = None, body_size: Column | None = None) -> Column:
    """struct of probabilities that an element is header, footer, body, page number or footnote, summing to 1."""
    size = F.lit(0.0) if size is None else size
    body_size = F.lit(10.0) if body_size is None else body_size
    t = stripped(text)
    has, n = t != "", F.length(t)
    top, bottom, low = rel_y < 0.08, rel_y > 0.92, (rel_y > 0.80) & (rel_y <= 0.92)
    number = has & t.rlike(f"(?U){PAGE_NUMBER}")
    note = has & t.rlike(r"(?U)\A[\d*†‡]+[.)]\s")
    small, large = has & (size > 0) & (size < body_size * 0.8), has & (size > body_size * 1.3)
    long = has & (n > 200)
    plus = lambda cond, k: F.when(cond, k).otherwise(0.0)
    header = F.when(top, 0.7).when(bottom | low, 0.0).otherwise(0.05) + plus(has & (n < 50) & (rel_y < 0.1), 0.15) + plus(has, 0.2) + plus(large, 0.1)
    footer = F.when(top, 0.0).when(bottom, 0.6).when(low, 0.2).otherwise(0.05) + plus(has & (n < 50) & (rel_y > 0.9), 0.15)
    body = F.when(top, 0.2).when(bottom, 0.15).when(low, 0.4).otherwise(0.85)
    body = F.when(number, F.least(body, F.lit(0.1))).otherwise(body)
    page = F.when(bottom, 0.2).otherwise(0.0)
    page = F.when(number, F.greatest(page, F.lit(0.85))).otherwise(page)
    foot = F.when(low, 0.3).otherwise(0.0) + plus(note, 0.3) + plus(note & (rel_y > 0.7), 0.2) + plus(small, 0.2)
    header, footer = F.when(long, F.least(header, F.lit(0.05))).otherwise(header), F.when(long, F.least(footer, F.lit(0.05))).otherwise(footer)
    body = F.when(long, F.greatest(body, F.lit(0.9))).otherwise(body)
    total = header + footer + body + page + foot
    return F.struct(*((v / total).alias(k) for k, v in (("header", header), ("footer", footer), ("body", body), ("page_number", page), ("footnote", foot))))
