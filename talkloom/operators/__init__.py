"""DataFrame operators over conversations, messages, terms and items."""
