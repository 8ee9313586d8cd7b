"""Training-data operators over documents and conversations."""
