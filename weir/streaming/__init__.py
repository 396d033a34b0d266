from weir.streaming.feed import event_feed, events_after
from weir.streaming.incremental import gated_stream, upsert_stream

__all__ = ["event_feed", "events_after", "gated_stream", "upsert_stream"]
