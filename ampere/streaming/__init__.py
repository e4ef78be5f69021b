from .market_stream import market_view_stream, signal_stream

__all__ = ["market_view_stream", "signal_stream"]
