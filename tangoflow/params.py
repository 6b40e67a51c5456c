"""One frozen parameter object instead of a config file.

"today", "now" and the seed are always arguments; nothing reads the clock.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference application's behaviour.
# ---------------------------------------------------------------------------
# Review interval (days): success-rate thresholds are inclusive, checked from
# the top; interval = base * (1 + streak // 2), capped.
RATE_THRESHOLDS = (0.9, 0.7, 0.5)          # -> bases 7, 3, 2
RATE_BASES = (7, 3, 2)
RATE_BASE_FLOOR = 1                        # below 0.5
MAX_INTERVAL_DAYS = 30
# Documented alternative schedule: step n (correct answers stored before this
# review, counted from 0) of these days on a hit; beyond the list the last
# value doubles each step; a miss resets to one day.
LADDER_DAYS = (1, 3, 7, 14, 30, 90)
LADDER_MISS_DAYS = 1
LADDER_MAX_DOUBLINGS = 40  # own bound: 2^40 steps are past any calendar day
# Quiz: at most this many words per session, default session size.
MAX_QUIZ_WORDS = 20
DEFAULT_QUIZ_WORDS = 10
# Recent conversations slider: 1..20, default 5.
MAX_RECENT_CHATS = 20
DEFAULT_RECENT_CHATS = 5
# Settings defaults (filled when a key is missing), JSON-encoded values.
SETTING_DEFAULTS = (
    ("preferred_level", '"Beginner"'),
    ("favorite_topics", "[]"),
    ("daily_goal", "5"),
)
# Conversation levels and topics offered by the app.
LEVELS = ("Beginner", "Intermediate", "Advanced")
APP_TOPICS = ("Daily Greetings", "Food & Restaurants", "Travel", "Work & School", "Hobbies",
              "Free Conversation")
# Topic -> suggested questions.
TOPIC_SUGGESTIONS = (
    ("Daily Greetings", ("How do you say 'good morning'?", "What's a polite way to say goodbye?")),
    ("Food & Restaurants", ("How do I order sushi?", "What does 'oishii' mean?")),
    ("Travel", ("How do I ask for directions?", "What's the word for 'train station'?")),
    ("Work & School", ("How do you say 'meeting' in Japanese?", "What does 'ganbatte' mean?")),
    ("Hobbies", ("How do I talk about my hobbies?", "What's the word for 'music'?")),
    ("Free Conversation", ("Tell me about Japanese culture", "What's a common Japanese greeting?")),
)
# Proficiency level -> difficulty; unknown levels map to 3; source = prefix+level.
PROFICIENCY_DIFFICULTY = (("N5", 1), ("N4", 2), ("N3", 3), ("N2", 4), ("N1", 5))
PROFICIENCY_UNKNOWN = 3
PROFICIENCY_SOURCE_PREFIX = "jlpt_"
# Pair formatting: model-input prefix, confidence by difficulty (<= 2 -> high).
PAIR_PREFIX = "grammar: "
CONFIDENCE_HIGH = 1.0
CONFIDENCE_LOW = 0.8
CONFIDENCE_MAX_EASY_LEVEL = 2
UNKNOWN_CATEGORY = "unknown"
# Model input: sequence length, label ignore id, split and batch sizes.
MAX_SEQ_LEN = 128
LABEL_IGNORE = -100
VALIDATION_FRACTION = 0.2
SPLIT_SEED = "42"
TRAIN_BATCH = 2
DEFAULT_BATCH = 4
EPOCHS = 3
TEMPLATE_DRAWS = 10
TEMPLATE_LEVEL = 2
# Date/time text formats at the I/O edges.
DAY_FORMAT = "yyyy-MM-dd"
MINUTE_FORMAT = "yyyy-MM-dd HH:mm"
SECOND_FORMAT = "yyyy-MM-dd HH:mm:ss"
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Params:
    today: _dt.date = _dt.date(2024, 1, 30)
    seed: str = "42"
    max_quiz_words: int = MAX_QUIZ_WORDS
    quiz_words: int = DEFAULT_QUIZ_WORDS
    recent_chats: int = DEFAULT_RECENT_CHATS
    # Groups of more rows (a learner's word, a conversation, equal chats) are cut
    # into blocks, each a task's work (see operators.split); None: never.
    split_rows: int | None = 1_000_000
    max_seq_len: int = MAX_SEQ_LEN
    vocab_size: int = 5000
    batch_size: int = DEFAULT_BATCH
    extra: dict = field(default_factory=dict, compare=False, hash=False)


DEFAULT = Params()
