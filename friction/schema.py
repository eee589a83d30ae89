"""Event schema, rule parameters and the fixed vocabulary of the engine."""

from __future__ import annotations

#: Event types that are accepted, and those that are stored.
EVENT_TYPES = ("CLICK", "INPUT_CHANGE", "FOCUS", "BLUR", "SUBMIT", "NAVIGATION", "HOVER", "SCROLL", "PASTE", "COPY", "KEY_DOWN", "VALIDATION_ERROR", "JS_ERROR", "DWELL", "CUSTOM")
STORED_TYPES = ("CLICK", "INPUT_CHANGE", "SUBMIT", "NAVIGATION", "HOVER", "DWELL", "CUSTOM")

#: Thresholds of the rules, in milliseconds and counts.
RULES = {
    "rage_n": 3, "rage_ms": 2000, "mis_ms": 300, "thrash_n": 5, "thrash_ms": 4000, "backtrack_flips": 3, "backtrack_n": 4,
    "backtrack_ms": 8000, "validation_n": 2, "abandon_ms": 30000, "paste_n": 2, "paste_ms": 5000, "password_n": 2,
    "slow_n": 4, "slow_min_ms": 30000, "slow_max_ms": 60000, "loop_n": 3, "silent_ms": 8000, "back_n": 3, "back_ms": 5000,
    "dead_end_ms": 20000, "bounce_ms": 1500, "circular_n": 2, "hunt_n": 6, "hunt_ms": 4000, "hunt_click_ms": 500,
    "dwell_ms": 30000, "scroll_n": 5, "scroll_ms": 2000, "overshoot_n": 4, "overshoot_turns": 3, "overshoot_ms": 6000,
    "idle_load_ms": 15000, "search_n": 2, "menu_n": 3, "menu_ms": 5000, "tooltip_n": 3, "tab_n": 3, "tab_ms": 8000,
    "dismiss_n": 2, "retry_n": 2, "missing_ms": 3000, "locked_n": 5, "lost_focus_ms": 500, "copy_ms": 5000,
    "baseline_min": 10, "baseline_factor": 1.5,
}

#: Validity flags that count as a format error.
FORMAT_FLAGS = ("typeMismatch", "patternMismatch", "tooShort", "tooLong", "rangeUnderflow", "rangeOverflow", "stepMismatch")

#: Columns of an event as the rules read it. ms: milliseconds; seq: arrival order among equal ms.
EVENT_COLUMNS = {
    "session_id": "string", "element_id": "string", "route": "string", "event_type": "string", "ms": "long", "seq": "long",
    "m_kind": "string", "m_role": "string", "m_disabled": "boolean", "m_dead": "boolean", "m_empty": "boolean",
    "m_results": "double", "m_query": "string", "m_trigger": "string", "m_ms": "double", "m_tooltip": "boolean",
    "m_length": "double", "m_dy": "double", "m_target": "string", "m_message": "string", "el_role": "string",
    "el_disabled": "boolean", "el_dead": "boolean", "el_form_valid": "boolean", "el_validity": "string",
}
