"""Thresholds of the operators, in one place; ``Thresholds(**changes)`` overrides some."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # The defaults that results depend on.
    text_min_visible_chars: int = 50
    image_only_max_visible_chars: int = 10
    image_area_ratio_min: float = 0.60
    broken_text_replacement_share: float = 0.20
    broken_text_dict_hit_min: float = 0.35
    full_page_area_ratio: float = 0.95
    strip_aspect_ratio: float = 8.0
    ornament_max_side_pt: float = 48.0
    ornament_min_pages: int = 3
    ornament_page_share: float = 0.30
    scanned_page_share: float = 0.50
    dup_line_frac: float = 0.30
    dup_para_frac: float = 0.30
    top_2gram_frac: float = 0.20
    top_3gram_frac: float = 0.18
    top_4gram_frac: float = 0.16
    max_non_alpha_words_ratio: float = 0.8
    mean_word_len_min: float = 3.0
    mean_word_len_max: float = 10.0
    lang_block_min_words: int = 5
    lang_block_min_confidence: float = 0.60
    lang_block_override_max_share: float = 0.20
    dup_block_min_chars: int = 40
    furniture_min_repeat_pages: int = 3
    furniture_min_repeat_page_share: float = 0.20
    furniture_repetition_ratio_min: float = 0.70
    furniture_repetition_ratio_grey_min: float = 0.30
    furniture_window_pages: int = 20
    folio_constant_min_share: float = 0.15
    legible_min_chars: int = 2
    legible_min_share: float = 0.6
    function_word_rank: int = 30
    stem_min_chars: int = 4
    stem_tail_chars: int = 3
    style_min_words: int = 2000
    lower_compound_rate_max: float = 0.0005
    noun_capital_rate_min: float = 0.15
    size_quantum_pt: float = 0.5
    bold_weight_min: int = 600
    candidate_max_char_share: float = 0.15
    caption_distance_ratio_min: float = 1.5
    min_char_retention: float = 0.98
    global_non_ocr_removal: float = 0.08
    split_bytes: int = 260_000
    h1_count_min: int = 2
    h1_count_max: int = 60
    assertion_min_instances: int = 30
    assertion_confidence: float = 0.95
    exact_below: int = 25
    ours_max_share: float = 0.40
    holdout_min_files: int = 100
    heartbeat_timeout_secs: int = 6
    line_baseline_tolerance_ratio: float = 0.30
    rule_max_thickness_pt: float = 3.0
    rule_min_aspect: float = 10.0
    max_page_glyphs: int = 1_000_000
    max_image_pixels: int = 100_000_000
    background_min_page_chars: int = 200
    scan_book_min_share: float = 0.5
    second_lang_block_share: float = 0.20
    superscript_rise_ratio: float = 0.30
    superscript_size_ratio_max: float = 0.80
    line_split_gap_em: float = 1.2
    fallback_space_ratio: float = 0.25
    min_space_ratio: float = 0.15
    gutter_min_width_em: float = 0.5
    gutter_emptiness_min: float = 0.98
    gutter_height_share_min: float = 0.6
    column_span_share: float = 0.25
    continuity_break_max: float = 0.30
    max_column_retries: int = 2
    size_barrier_ratio: float = 0.15
    whitespace_max_rectangles: int = 40
    whitespace_fuzziness: float = 0.15
    whitespace_min_area: float = 1.0
    separator_height_ratio: float = 0.5
    agreement_iou_min: float = 0.8
    dropcap_min_height_lines: float = 2.0
    indent_min_em: float = 1.0
    indent_convention_min_share: float = 0.05
    line_unwrap_factor: float = 0.45
    extra_leading_ratio: float = 1.5
    word_space_em: float = 0.3
    furniture_band_ratio: float = 0.08
    furniture_ned_max: float = 0.15
    furniture_y_cluster_ratio: float = 0.50
    furniture_body_size_tolerance: float = 0.05
    back_min_page_share: float = 0.5
    front_title_max_words: int = 60
    front_dedication_max_words: int = 30
    front_epigraph_max_words: int = 90
    front_min_title_key: int = 3
    note_size_ratio_max: float = 0.85
    note_zone_band_min: float = 0.55
    note_rule_max_width_ratio: float = 0.40
    note_rule_gap_max_em: float = 3.0
    caption_max_width_ratio: float = 1.0
    monospace_min_runs: int = 4
    list_min_siblings: int = 2
    list_indent_step_pt: float = 3.0
    list_max_depth: int = 5
    cluster_char_share_min: float = 0.6
    short_line_max_width_ratio: float = 0.60
    space_above_min_em: float = 1.2
    size_rank_max_level: int = 3
    outline_match_ned_max: float = 0.25
    outline_trust_min_bound_share: float = 0.5
    outline_trust_min_distinct_share: float = 0.8
    opener_sink_em: float = 3.0
    opener_min_chain: int = 3
    opener_min_page_gap: int = 2
    opener_max_lines: int = 2
    opener_max_tokens: int = 4
    runin_max_words: int = 8
    join_gap_em: float = 1.2
    label_title_gap_em: float = 3.0
    level_size_tolerance: float = 0.10
    toc_indent_step_pt: float = 4.0
    grid_snap_pt: float = 3.0
    rule_join_gap_pt: float = 3.0
    rule_overlap_min: float = 0.5
    table_min_row_rules: int = 2
    table_min_column_rules: int = 2
    table_min_columns: int = 2
    table_min_aligned_rows: int = 2
    table_min_aligned_row_share: float = 0.5
    table_min_taken_text_share: float = 0.5
    classifier_margin_min: float = 0.25
    tagged_share_target: float = 0.126
    tagged_share_tolerance: float = 0.05
    #: Not a threshold of results: the width of the cells in which boxes of a page meet.
    grid_cell_pt: float = 50.0


DEFAULT = Thresholds()
