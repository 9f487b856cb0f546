"""Structured Streaming: replay source, windowed features, batch scoring with carried state, points."""
