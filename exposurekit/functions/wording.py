"""Fixed wording of prompts and fixed names of features.

Answers can only be compared with answers to the same questions, so these texts and
names are fixed values; everything else about a prompt is assembled from columns.
"""

# --- fixed values -------------------------------------------------------------------

USER_FEATURES = (
    "u_age", "u_gender", "u_country", "u_device_brand", "u_device_price", "u_fans_num",
    "u_follow_num", "u_accu_watch_live_cnt", "u_accu_watch_live_duration",
    "u_is_live_streamer", "u_is_photo_author",
)
STREAMER_FEATURES = (
    "s_gender", "s_age", "s_country", "s_device_brand", "s_device_price",
    "s_live_operation_tag", "s_fans_user_num", "s_fans_group_fans_num", "s_follow_user_num",
    "s_accu_live_cnt", "s_accu_live_duration", "s_accu_play_cnt", "s_accu_play_duration",
)
CONTEXT_FEATURES = ("r_content_category", "r_live_type", "ctx_hour", "ctx_dayofweek")
HISTORY_FEATURES = ("user_ctr", "user_n", "streamer_ctr", "streamer_n", "cat_ctr")

DISPLAY_PREFIXES = {"u_": "user.", "s_": "streamer.", "r_": "room.", "ctx_": "ctx."}

AGE_BANDS = ("12-17", "18-23", "24-30", "31-40", "41-49", "50+")
COARSE_AGE = {
    "12-17": "<24", "18-23": "<24", "24-30": "24-40", "31-40": "24-40", "41-49": "40+", "50+": "40+",
}
COARSE_AGE_BANDS = ("<24", "24-40", "40+")
GIFT_TIERS = ("Low", "Mid", "High")
FAILED_RATIONALE = "Mixed engagement signals across user activity, streamer niche, and timing."
BLEND_WEIGHTS = (0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0)

# US dollars per million tokens, in and out
TOKEN_PRICES = {"gpt-4o": (2.50, 10.0), "gpt-4o-mini": (0.15, 0.60)}
FALLBACK_PRICE_MODEL = "gpt-4o"

PREDICT_PREFIX = "You are predicting user engagement on a live-streaming platform.\nExposure features:\n"
PREDICT_QUESTION = (
    "\n\nWill this user click into this live room? "
    "Answer with a single digit: 1 = click, 0 = no click."
)
NOTES_HEAD = "CORRECTION NOTES (from analyzing prediction errors):\n"

FEATURES_HEAD = "Exposure features:\n"
ANSWER_FIRST_QUESTION = (
    "\n\nFirst give the click prediction as `Answer: 1` (click) or `Answer: 0` (no click). "
    "Then on a new line explain in one sentence, citing the key features (`Because: ...`)."
)
TEACHER_QUESTION = "\n\nOne-sentence signal:"

EXAMPLES_HEAD = (
    "Below are labeled exposure examples. Identify the key conditional patterns that "
    "distinguish clicked=1 from clicked=0 (e.g., interactions among user engagement history, "
    "streamer content niche/popularity, and time-of-day). Return a concise, structured set of "
    "rules/relationships (<= 350 words).\n\n"
)
PATTERNS_HEAD = "LEARNED CLICK PATTERNS:\n"
ERRORS_HEAD = (
    "These exposures were MISPREDICTED (with true vs predicted labels). Diagnose the systematic "
    "gaps and rewrite an improved description (<= 350 words).\n\n"
)
GUIDE_ERRORS_HEAD = "Mispredicted exposures (true vs predicted):\n"

REGIME_TITLES = (
    "A. High-affinity click (user & streamer both hot)",
    "B. Cold exposure, no click (both CTRs low)",
    "C. Streamer-pull click (low user_ctr, high streamer_ctr)",
    "D. Active user skips a weak streamer (high user_n, low streamer_ctr)",
    "E. Category-driven click (high cat_ctr)",
)
CARD_FEATURES = (
    "user_ctr", "user_n", "streamer_ctr", "streamer_n", "cat_ctr",
    "r_content_category", "ctx_hour", "u_accu_watch_live_cnt", "s_fans_user_num",
)

# --- end of fixed values ------------------------------------------------------------


def display_name(feature: str) -> str:
    for prefix, shown in DISPLAY_PREFIXES.items():
        if feature.startswith(prefix):
            return shown + feature[len(prefix) :]
    return feature
