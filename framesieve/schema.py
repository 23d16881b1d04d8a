"""Fixed schemas of the engine's tables."""

from __future__ import annotations

VIDEOS = "video_id string, video_path string, fps double, total_frames bigint"
FRAMES = "video_id string, frame_idx bigint, height int, width int, n_channels int, data binary"
REFERENCES = "video_id string, ref_no bigint, caption string"
CAPTIONS = "video_id string, method string, frame_idx bigint, caption string, vlm_model_id string, vlm_revision string"
TRANSCRIPTS = "video_id string, transcript string, audio_present boolean, audio_duration double"
FRAME_SELECTION = (
    "sampler string, video_id string, original_frame_count bigint, selected_frame_count bigint, frame_indices array<bigint>, "
    "reduction_pct double, threshold_used double, fallback_used boolean, fps double"
)
RESULTS = (
    "video_id string, sampling_method string, aggregation_method string, caption_mode string, frames_selected bigint, "
    "processing_time_s double, peak_vram_mb double, peak_ram_delta_mb double, gpu_utilization_pct double, "
    "cider double, bleu1 double, bleu4 double, rouge_l double, meteor double, "
    "tass_candidate_pool bigint, tass_degenerate_dropped bigint, tass_stopped_early boolean, vlm_calls_saved_pct double, semantic_yield double"
)
BASELINE = (
    "video_id string, benchmark_type string, sampling_method string, aggregation_method string, caption_mode string, "
    "frames_selected bigint, actual_frames_used bigint, oom_fallback_triggered boolean, processing_time_s double, peak_vram_mb double, "
    "peak_ram_delta_mb double, gpu_utilization_pct double, cider double, bleu1 double, bleu4 double, rouge_l double, meteor double, generated_caption string"
)


def names(schema: str) -> list[str]:
    """Column names of a schema, in order."""
    return [part.split()[0] for part in schema.split(", ")]
