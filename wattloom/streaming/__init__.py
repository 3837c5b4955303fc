"""The hourly and daily roll-up over a stream of readings."""
