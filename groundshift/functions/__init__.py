"""Column-level building blocks."""

from .boxes import area, box, clamp_box, iou, to_percent, to_pixels, to_scene
from .numeric import clamp01, round_half_up, shrink_to
from .pixels import stretch_u8, to_grey, u16_to_u8
from .text import data_url_parts, first_text, interpolate, strip_fences, to_data_url, web_trim

__all__ = [
    "area", "box", "clamp01", "clamp_box", "data_url_parts", "first_text", "interpolate", "iou",
    "round_half_up", "shrink_to", "stretch_u8", "strip_fences", "to_data_url", "to_grey",
    "to_percent", "to_pixels", "to_scene", "u16_to_u8", "web_trim",
]
