"""DataFrame-in, DataFrame-out operators over packets, messages and streams."""
