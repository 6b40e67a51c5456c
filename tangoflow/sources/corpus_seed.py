"""Reference data for the sentence-pair corpus.

Fixed values: these rows, templates and slot lists must equal the original
application's for the same corpus to come out.  They are data, shipped as
they are (natural order), and unioned with pairs built from the corpus
tables at scale.
"""

from __future__ import annotations

# --- Fixed values: curated pairs (incorrect, correct, error_type, level) ---
EXPERT_PAIRS = (
    ("私が日本人です。", "私は日本人です。", "particle_wa_ga", 1),
    ("今日が暑いです。", "今日は暑いです。", "particle_wa_ga", 1),
    ("田中さんが先生です。", "田中さんは先生です。", "particle_wa_ga", 1),
    ("本が読みます。", "本を読みます。", "particle_wo", 1),
    ("音楽が聞きます。", "音楽を聞きます。", "particle_wo", 1),
    ("映画が見ました。", "映画を見ました。", "particle_wo", 1),
    ("日本語が勉強します。", "日本語を勉強します。", "particle_wo", 1),
    ("学校で行きます。", "学校に行きます。", "particle_ni_de", 2),
    ("図書館に勉強します。", "図書館で勉強します。", "particle_ni_de", 2),
    ("東京で住んでいます。", "東京に住んでいます。", "particle_ni_de", 2),
    ("昨日映画を見ます。", "昨日映画を見ました。", "tense_past", 2),
    ("明日友達と会いました。", "明日友達と会います。", "tense_future", 2),
    ("今朝パンを食べます。", "今朝パンを食べました。", "tense_past", 2),
    ("昨日は楽しいでした。", "昨日は楽しかったです。", "adjective_past", 3),
    ("この本は面白いでした。", "この本は面白かったです。", "adjective_past", 3),
    ("料理は美味しいでした。", "料理は美味しかったです。", "adjective_past", 3),
    ("学校に行きました昨日。", "昨日学校に行きました。", "word_order", 3),
    ("友達と映画を見ました今日。", "今日友達と映画を見ました。", "word_order", 3),
    ("日本語を勉強しています大学で。", "大学で日本語を勉強しています。", "word_order", 3),
    ("私田中です。", "私は田中です。", "missing_particle", 1),
    ("学校行きます。", "学校に行きます。", "missing_particle", 2),
    ("友達話しました。", "友達と話しました。", "missing_particle", 2),
    ("日本に行くつもりでした。", "日本に行くつもりです。", "verb_form", 4),
    ("明日は忙しくなりました。", "明日は忙しくなります。", "verb_form", 4),
)
LEARNER_PAIRS = (
    ("私は好きです寿司を。", "私は寿司が好きです。", "word_order_english", 2),
    ("私は行きます学校に車で。", "私は車で学校に行きます。", "word_order_english", 3),
    ("それは本です面白い。", "それは面白い本です。", "adjective_placement", 2),
    ("私は学生だます。", "私は学生です。", "overgeneralization", 1),
    ("今日は寒いますね。", "今日は寒いですね。", "overgeneralization", 2),
    ("私は18歳を持っています。", "私は18歳です。", "literal_translation", 2),
    ("私は名前を田中と呼ばれています。", "私の名前は田中です。", "literal_translation", 3),
    ("先生、おはよう！", "先生、おはようございます！", "politeness_level", 2),
    ("すみません、トイレはどこですか？", "すみません、お手洗いはどこですか？", "politeness_level", 3),
)
# (incorrect, correct, error_type, proficiency level)
PROFICIENCY_PAIRS = (
    ("これが私の本です。", "これは私の本です。", "demonstrative_particle", "N5"),
    ("私の名前田中です。", "私の名前は田中です。", "topic_particle", "N5"),
    ("今何時ですか？", "今何時ですか？", "correct", "N5"),
    ("友達と映画を見に行くつもりでした。", "友達と映画を見に行くつもりです。", "intention_tense", "N4"),
    ("雨が降っているので、家にいるつもりでした。", "雨が降っているので、家にいるつもりです。", "intention_tense", "N4"),
    ("彼は来るかもしれませんでした。", "彼は来るかもしれませんでした。", "correct", "N3"),
    ("この問題は難しすぎて解けませんでした。", "この問題は難しすぎて解けませんでした。", "correct", "N3"),
)
# Templates: (correct template, faulty template, error_type).
TEMPLATES = (
    ("{subject}は{object}を{verb}ます。", "{subject}が{object}を{verb}ます。", "particle_wa_ga"),
    ("{subject}は{object}を{verb}ます。", "{subject}は{object}が{verb}ます。", "particle_wo"),
    ("{place}で{activity}ます。", "{place}に{activity}ます。", "particle_ni_de"),
    ("{place}に行きます。", "{place}で行きます。", "particle_ni_de"),
    ("昨日{object}を{past_verb}。", "昨日{object}を{present_verb}。", "tense_mismatch"),
    ("明日{object}を{present_verb}。", "明日{object}を{past_verb}。", "tense_mismatch"),
)
SLOTS = {
    "subject": ("私", "友達", "先生", "学生", "母", "父", "姉", "弟"),
    "object": ("本", "映画", "音楽", "料理", "宿題", "手紙", "写真", "ゲーム"),
    "verb": ("読み", "見", "聞き", "作り", "し", "書き", "撮り", "遊び"),
    "place": ("学校", "図書館", "公園", "家", "駅", "病院", "銀行", "店"),
    "activity": ("勉強し", "読書し", "運動し", "買い物し", "食事し", "会議し"),
    "past_verb": ("読みました", "見ました", "聞きました", "作りました", "しました", "書きました"),
    "present_verb": ("読みます", "見ます", "聞きます", "作ります", "します", "書きます"),
}
SOURCES = {"expert": "expert_curated", "template": "synthetic", "learner": "lang8_style", "injected": "injected"}
# --- end of fixed values ---
