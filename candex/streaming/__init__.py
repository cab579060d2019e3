"""Streaming forms of the reassembly, counting, selection, gate and marker operators."""
