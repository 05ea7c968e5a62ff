"""Every tunable of a run, and the constants behind the confidences."""

from __future__ import annotations

from dataclasses import dataclass

# File extensions by class.
RAW_EXTENSIONS = ("dng", "cr2", "cr3", "nef", "arw", "orf", "rw2", "raf", "pef", "srw")
PHOTO_EXTENSIONS = ("jpg", "jpeg", "jpe", "png", "heic", "heif", "avif", "webp", "gif", "bmp", "tif", "tiff", "jxl", *RAW_EXTENSIONS)
VIDEO_EXTENSIONS = ("mp4", "m4v", "mov", "avi", "mkv", "wmv", "mts", "m2ts", "3gp", "webm", "mpg", "mpeg")

# Kinds in order, and their confidences.
KINDS = ("ExactBytes", "IdenticalPixels", "Perceptual", "Burst", "VideoSampled")
EXACT_CONFIDENCE, PIXEL_CONFIDENCE, SAMPLED_CONFIDENCE = 100.0, 99.0, 99.0
PERCEPTUAL_MAX, PERCEPTUAL_MIN, BURST_MAX, EDITED_CAP, INDIRECT_CONFIDENCE = 98.0, 50.0, 89.0, 80.0, 50.0
AUTO_FLOOR, SAME_KIND_FLOOR, MIN_FREE_FRACTION = 90.0, 60.0, 0.10
DISTINCT_CAPTURE_US, FAR_METRES = 50_000, 200.0


@dataclass(frozen=True)
class Options:
    """Defaults of a run; see the README for what each level does with them."""

    recursive: bool = True
    include_hidden: bool = False
    include_videos: bool = False
    quick_video_check: bool = False
    video_sample_blocks: int = 16
    partial_hash_bytes: int = 65_536
    thumbnail_side: int = 256
    perceptual_max_distance: int = 8
    burst_max_distance: int = 22
    burst_window_seconds: float = 10.0
    burst_min_cosine: float = 0.88
    detect_bursts: bool = True
    burst_neighbours: int = 60
    mode: str = "ReadOnly"  # ReadOnly, Assisted, SemiAutomatic, Automatic
    auto_threshold: float = 99.0
    disposal: str = "Quarantine"  # Quarantine, RecycleBin
    verify_before_move: bool = False
    preferred_folders: tuple[str, ...] = ()
    cross_folder_only: bool = False
    quarantine: str = "/.quarantine"
    #: Beyond so many hashes the similarity join uses bands instead of comparing all pairs.
    brute_force_hashes: int = 2_000

    @property
    def effective_threshold(self) -> float:
        return max(self.auto_threshold, AUTO_FLOOR)
