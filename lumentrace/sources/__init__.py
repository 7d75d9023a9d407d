"""Readers and writers: measurement lists, region files, stacks, movement lists, exports."""
