"""DataFrame-to-DataFrame operators over episodes, frames and state tables."""
