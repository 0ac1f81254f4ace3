"""DataFrame operators over volumes, stacks, the object index and evaluation rows."""
