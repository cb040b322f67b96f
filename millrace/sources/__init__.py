"""File sources and sinks, record codecs, and service interfaces."""
