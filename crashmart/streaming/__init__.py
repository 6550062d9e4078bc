"""Empty on purpose: every input of this library is a frozen snapshot, so no operator here is a streaming one."""
