"""Streams: envelopes into valid and quarantined batches, ledgers of messages, refreshes of late days, cooldowns."""
