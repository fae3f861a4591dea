"""Values that decide results and therefore stay exactly as given."""

# --- Fixed values: categories ------------------------------------------------
POSITIVE = "pos"
NEUTRAL = "neu"
NEGATIVE = "neg"
SENTIMENTS = (POSITIVE, NEUTRAL, NEGATIVE)
ANY_SENTIMENT = "any"

# --- Fixed values: sizes and gates -------------------------------------------
MAX_VARIANTS = 3            # query variants used per question
ANSWER_CANDIDATES = 40      # vectors fetched per variant for an answer
ANSWER_MIN_MATCHES = 3      # title matches needed before the title filter applies
ANSWER_HITS = 8             # reviews passed on for an answer
ANSWER_SOURCES = 3          # sources displayed with an answer
TOPIC_CANDIDATES = 200      # vectors fetched per variant for pros and cons
TOPIC_MIN_MATCHES = 20
TOPIC_PER_SIDE = 25
MIN_PER_SIDE = 3            # reviews needed on each side before anything is summarised
PRODUCT_SAMPLES = 15        # positive and negative samples per product
PRODUCT_SHOWN = 3           # positive and negative reviews displayed per product
COMPARE_REVIEWS = 15
SERIES_MIN_REVIEWS = 5
ROLLING_DAYS = 30
WINDOW_DAYS = {"1Y": 365, "5Y": 365 * 5}
HISTORY_TURNS = 5
LEADERBOARD_ROWS = 100
LEADERBOARD_SHOWN = 40
DISPLAY_SAMPLE = 5_000

# --- Fixed values: text widths and markers -----------------------------------
CONTEXT_CHARS = 500
TOPIC_CHARS = 300
COMPARE_CHARS = 250
CARD_CHARS, CARD_MARK = 400, "..."
PREVIEW_CHARS, PREVIEW_MARK = 220, "…"
SOURCE_LABEL_CHARS, PICKER_LABEL_CHARS, ROW_LABEL_CHARS = 60, 70, 80

# --- Fixed values: text formats ----------------------------------------------
CONTEXT_LINE = "[Review {number}] Product: {product} | Rating: {rating}/5 | Sentiment: {sentiment}\n{text}"
CONTEXT_SEPARATOR = "\n\n"
TOPIC_LINE = "- {text}"
COMPARE_LINE = "- [{rating}/5] {text}"
NOTHING_FOUND = "No relevant reviews found for that question."
NOT_ENOUGH_TO_COMPARE = "Not enough reviews to compare."

REWRITE_PROMPT = """User question: "{question}"

Extract:
- search_queries: 1-3 short phrases optimized for semantic search over review text
- sentiment: "pos", "neg", or "any"
- product_hint: a keyword to filter product titles, or null

Return JSON only:
{"search_queries":["..."],"sentiment":"...","product_hint":"..."}"""
TOPIC_QUESTION = "pros and cons of {topic}"

ANSWER_PROMPT = "Question: {question}\n\nReviews:\n{context}"

PROS_CONS_PROMPT = """Analyze reviews for "{topic}". Extract TOP 3 PROS and TOP 3 CONS.

POSITIVE:
{positive}

NEGATIVE:
{negative}

Return EXACTLY in this format with no extra text:
PROS
1. [point] - [short explanation]
2. [point] - [short explanation]
3. [point] - [short explanation]
CONS
1. [point] - [short explanation]
2. [point] - [short explanation]
3. [point] - [short explanation]"""

COMPARE_PROMPT = """Compare these two products.

PRODUCT A: {product_a}
Reviews:
{reviews_a}

PRODUCT B: {product_b}
Reviews:
{reviews_b}

Format:
**Where A Wins:** [2 specific points]
**Where B Wins:** [2 specific points]
**Verdict:** [one sentence on who should buy which]"""

# Instructions that go before a prompt; pros and cons have none.
REWRITE_SYSTEM = (
    "You turn user questions about product reviews into structured search parameters. Return ONLY valid JSON."
)
ANSWER_SYSTEM = """You are a product review analyst. Answer using ONLY the reviews provided.
Format:
- Start with a bold TL;DR sentence.
- Then 3-5 themed insights as bullet points, each with a bold label followed by the insight.
- Cite reviews inline using the format (R3) or (R3, R5) — NEVER use brackets like [Review 3] because those break rendering.
- Be specific: name products, mention concrete features, cite reviewer language when relevant.
- Keep bullets tight — 1-2 sentences each, not paragraphs.
- If reviews don't answer the question, say so plainly.

Example good citation: "Users praise the glare-free screen (R4)."
Example bad citation: "Users praise the glare-free screen [Review 4]."
"""
COMPARE_SYSTEM = (
    "You compare two products based on customer reviews. Be concrete, balanced, and specific. "
    "Output in sections: Where A wins, Where B wins, Verdict."
)
CHART_SYSTEM = (
    "You are a data analyst. Given a chart description, explain the key insight in 2-3 sentences. "
    "Be specific, concrete, actionable. No fluff."
)

TREND_CHART = "Sentiment Over Time"
TREND_CONTEXT = (
    "Positive share: {pos}%, Negative share: {neg}%, Total reviews: {total}. "
    "The chart shows 30-day rolling mean of daily review volumes by sentiment, spanning ~15 years."
)
MIX_CHART = "Sentiment Mix"
MIX_CONTEXT = "Positive: {pos}%, Negative: {neg}%, Neutral: {neu}%. Total reviews: {total}."
PRICE_CHART = "Price vs Rating"
PRICE_CONTEXT = "Price brackets and their average ratings:\n{rows}"
PRICE_LINE = "- {bracket}: avg rating {rating}, {total} reviews"
CHART_PROMPT = "Chart: {chart}\n\nData:\n{context}\n\nWhat's the takeaway?"

# --- Fixed values: headers and patterns read back from generated text --------
PROS_HEADER = "PROS"
CONS_HEADER = "CONS"
A_WINS_HEADER = "where a wins"
B_WINS_HEADER = "where b wins"
VERDICT_HEADER = "verdict"
HEADER_DECORATION = r"[*:]+"
VERDICT_LEAD = r"(?i)^\s*\**\s*verdict\s*:?\s*\**\s*"
BULLET_LEAD = r"^\s*[\d*\-.)\s]+"
CODE_FENCE = "```"
CODE_FENCE_LANGUAGE = "json"
